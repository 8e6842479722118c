"""Mixing sources to target weights (problem 9): soft memberships and fitted document rates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrid.llm.functions.tokens import VOCABULARY, Domains, features, token_ids
from talkgrid.session import checkpointed

#: Labelled texts on which the classifier is fitted, at most (of the least text hash).
FIT_ROWS = 4000
BUCKETS = 1 << 11
#: Prior weight of the source a text is labelled with; the others share the rest.
LABEL_PRIOR = 0.999
#: Labelled texts whose label holds so much of their membership are dealt by their source's cut, the others each by their own rate.
DEALT = 0.95
#: Hash bins of a source in which the whole copies of its texts are cut, and bins all sources may have together.
BINS, ALL_BINS = 4096, 1 << 20
#: Bins beyond the cut that may be added to come nearer.
EXTRA_BINS = 12
#: Targets a plan may have; per-source vectors go to every task.
MAX_SOURCES = 5000
#: Texts, and memberships of all of them, that the driver holds while rates are fitted; beyond, every round is a distributed sum.
HELD_TEXTS, HELD_CELLS = 1 << 16, 1 << 21
#: Memberships in one matrix.
SLICE_CELLS = 1 << 20
#: Rounds of the projected gradient, and the largest miss (of the total) at which it ends.
ROUNDS, MISS = 200, 1e-5
#: Rounds in which a larger total has to reach the shares, and how near the largest total is searched.
TRY_ROUNDS, NEAR = 20, 1.05
#: Memberships of the texts a task remembers, so that copies are read once.
_SEEN_CELLS = 1 << 21

_MEASURED = T.StructType(
    [T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("tokens", T.LongType()), T.StructField("own", T.DoubleType()), T.StructField("q", T.BinaryType())]
)


def _features(path: str):
    @F.pandas_udf(T.StructType([T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("v", T.ArrayType(T.DoubleType()))]))
    def run(texts: pd.Series) -> pd.DataFrame:
        own = [features(token_ids(t, path), BUCKETS) for t in texts]
        return pd.DataFrame({"at": [a.astype(np.int32) for a, _ in own], "v": [v for _, v in own]})

    return run


def membership(posterior: np.ndarray, base: np.ndarray, label: int) -> np.ndarray:
    """The weights with which a text belongs to the sources, all of them, summing to 1.

    ``label`` (-1: none) enters as a prior of ``LABEL_PRIOR``, in place of the sources' shares ``base``; a source without texts has none and gets nothing.
    """
    n = len(posterior)
    q = posterior
    if label >= 0 and n > 1:
        prior = np.full(n, (1 - LABEL_PRIOR) / (n - 1))
        prior[label] = LABEL_PRIOR
        q = np.divide(q, base, out=np.zeros(n), where=base > 0) * prior
    return q / q.sum()


def _measure(model: Domains | None, sources: list[str], base: np.ndarray, path: str):
    at = [sources.index(n) for n in model.names] if model else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for pdf in batches:
            if len(seen) * len(sources) > _SEEN_CELLS:
                seen.clear()
            rows = []
            for key in zip(pdf.h1, pdf.h2, pdf.k, pdf.text):
                own = key[:3]
                if own not in seen:
                    ids = token_ids(key[3], path)
                    p = base.copy()
                    if model is not None and len(ids):
                        p = np.where(base > 0, 1e-12, 0.0)
                        p[at] += model.posterior(*features(ids, BUCKETS))
                    q = membership(p, base, own[2] - 1)
                    seen[own] = (len(ids), float(q[own[2] - 1]) if own[2] else 0.0, q.astype(np.float32).tobytes())
                rows.append((*own, *seen[own]))
            yield pd.DataFrame(rows, columns=_MEASURED.names).assign(id=pdf.id.to_numpy())

    return run


def _weights(own: pd.DataFrame, n: int) -> np.ndarray:
    """Memberships of the rows as a matrix."""
    return np.frombuffer(b"".join(own.q), np.float32).reshape(len(own), n).astype(float)


def _slices(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    """The rows in slices whose matrix of memberships stays small."""
    size = max(1, SLICE_CELLS // n)
    for pdf in batches:
        for at in range(0, len(pdf), size):
            yield pdf.iloc[at : at + size]


def _caps(own: pd.DataFrame, q: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Copies a text of the rows may have: those of its label, else the expected ones."""
    k = own.k.to_numpy()
    return np.where(k > 0, cap[np.maximum(k, 1) - 1], np.floor(q @ cap + 1e-9))


def _rates(q: np.ndarray, caps: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the projected gradient steps from 1."""
    rate = np.minimum(1.0, caps)
    if steps:
        for less in np.stack(steps) @ q.T:
            rate = np.clip(rate - less, 0.0, caps)
    return rate


def _totals(n: int, cap: np.ndarray, steps: list[np.ndarray], toward: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, most = np.zeros(n), np.zeros(n)
        for pdf in _slices(batches, n):
            q = _weights(pdf, n)
            caps = _caps(pdf, q, cap)
            total += (_rates(q, caps, steps) * pdf.tokens.to_numpy()) @ q
            most += (caps * pdf.tokens.to_numpy() * (q @ toward > 0)) @ q
        yield pd.DataFrame({"k": range(n), "t": total, "m": most})

    return run


class _Texts:
    """Texts with their labels, tokens and memberships: on the driver while they are few, else as a table."""

    def __init__(self, texts: DataFrame, cap: np.ndarray):
        self.table, self.n, self.cap = texts.select("k", "tokens", "q"), len(cap), cap
        most = min(HELD_TEXTS, HELD_CELLS // self.n)
        few = self.table.count() <= most
        self.held = pd.DataFrame([(r.k, r.tokens, bytes(r.q)) for r in self.table.collect()], columns=["k", "tokens", "q"]) if few else None

    def totals(self, steps: list[np.ndarray], toward: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens of every source at the rates after the steps, and at full repetition of the texts that lie ``toward`` a direction (default: of all)."""
        run = _totals(self.n, self.cap, steps, np.ones(self.n) if toward is None else toward)
        if self.held is not None:
            out = pd.concat(run(iter([self.held]))).groupby("k").sum()
            return out.t.to_numpy(), out.m.to_numpy()
        total, most = np.zeros(self.n), np.zeros(self.n)
        for r in self.table.mapInPandas(run, "k int, t double, m double").groupBy("k").agg(F.sum("t").alias("t"), F.sum("m").alias("m")).collect():
            total[r.k], most[r.k] = r.t, r.m
        return total, most


def fit_rates(texts: _Texts, planned: np.ndarray, total: float, have: np.ndarray, rounds: int = ROUNDS) -> tuple[list[np.ndarray], float, float]:
    """Steps of projected gradient on the squared misses of expected source tokens, the miss left, and a total that cannot be passed.

    A step takes from every rate what its sources have too much, per token they have; with mixed
    memberships it is halved whenever the squared miss grows.  In the direction of what is lacking, no total
    gives more than the texts that lie there, fully repeated; where that is less than ``total``, the fit ends.
    """
    steps: list[np.ndarray] = []
    size, best, bound = 1.0, np.inf, np.inf
    toward = None
    scale = max(total, 1.0)
    for _ in range(rounds):
        now_have, most = texts.totals(steps, toward)
        miss = now_have - total * planned
        if toward is not None and toward @ planned > 0:
            bound = min(bound, float(toward @ most / (toward @ planned)))
        now = float((miss**2).sum())
        if now > best and size > 1 / 64:
            # the last step went too far
            size /= 2
            steps[-1] = steps[-1] / 2
            continue
        if np.abs(miss).max() <= MISS * scale or best - now <= 1e-12 * scale**2 or bound < total * (1 - MISS):
            break
        best, toward = now, -miss
        steps.append(size * miss / have)
    else:
        miss = texts.totals(steps)[0] - total * planned
    return steps, float(np.abs(miss).max() / scale), bound


def fit_largest(texts: _Texts, planned: np.ndarray, least: float, most: float, have: np.ndarray) -> tuple[float, list[np.ndarray], float]:
    """The largest total between ``least`` and ``most`` that reaches the shares, to within ``NEAR``, with its steps and miss."""
    total = least
    steps, miss, bound = fit_rates(texts, planned, total, have)
    most = min(most, bound)
    while miss <= MISS and most > max(1.0, NEAR * total):
        more = float(np.sqrt(max(total, most / 1000) * most))
        tried, left, bound = fit_rates(texts, planned, more, have, TRY_ROUNDS)
        if left <= MISS:
            total, steps, miss, most = more, tried, left, min(most, bound)
        else:
            most = min(more, bound)
    return total, steps, miss


def _drawn(n: int, cap: np.ndarray, steps: list[np.ndarray]):
    """Whole copies of texts that no cut deals: the fitted rate, its fraction decided by the text's hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(batches, n):
            q = _weights(pdf, n)
            caps = _caps(pdf, q, cap)
            rate = _rates(q, caps, steps)
            copies = np.minimum(np.floor(rate) + (pdf.u.to_numpy() < rate - np.floor(rate)), caps)
            yield pdf[["first_id", "k", "tokens", "q"]].assign(copies=copies.astype("int64"))

    return run


def _given(n: int, cap: np.ndarray, steps: list[np.ndarray] | None = None):
    """Tokens that the rows give every source, and those from texts of other labels or none: by their copies, or at the rates after the steps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, foreign = np.zeros(n), np.zeros(n)
        for pdf in _slices(batches, n):
            q = _weights(pdf, n)
            times = pdf.copies.to_numpy() if steps is None else _rates(q, _caps(pdf, q, cap), steps)
            tokens = times * pdf.tokens.to_numpy()
            total += tokens @ q
            k = pdf.k.to_numpy()
            q[np.flatnonzero(k > 0), k[k > 0] - 1] = 0.0
            foreign += tokens @ q
        yield pd.DataFrame({"k": range(n), "t": total, "f": foreign})

    return run


def _summed(rows: DataFrame, run, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Both sums of :func:`_given` over all rows."""
    total, foreign = np.zeros(n), np.zeros(n)
    for r in rows.mapInPandas(run, "k int, t double, f double").groupBy("k").agg(F.sum("t").alias("t"), F.sum("f").alias("f")).collect():
        total[r.k], foreign[r.k] = r.t, r.f
    return total, foreign


class Mix:
    """The plan of a mix: ``documents`` (id, copies) and ``report`` (one row per source)."""

    def __init__(self, documents: DataFrame, report: DataFrame):
        self.documents, self.report = documents, report


REPORT = "source string, target_share double, planned_share double, texts bigint, available_tokens bigint, mixed_tokens bigint, soft_tokens double, reached_share double, rate double, most_copies bigint, rounds int, residual double"


def _cut(own: dict[int, int], rest: float, bins: int) -> tuple[float, list[int]]:
    """A hash below which texts get one copy more, and single bins above it, so that ``rest`` tokens come out."""
    order = sorted(own.items())
    filled, j, cut = 0.0, 0, 0.0
    while j < len(order) and filled + order[j][1] <= rest:
        filled += order[j][1]
        cut = (order[j][0] + 1) / bins
        j += 1
    more: list[int] = []
    others = sorted(order[j:], key=lambda x: -x[1])
    for b, t in others:
        if len(more) < EXTRA_BINS and filled + t <= rest:
            more.append(b)
            filled += t
    open_bins = [(t, b) for b, t in others if b not in more]
    if open_bins and abs(filled + min(open_bins)[0] - rest) < abs(filled - rest):
        more.append(min(open_bins)[1])
    return cut, more


def mix_to_targets(documents: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, share_col: str, cap_col: str, vocabulary: str = VOCABULARY, total_tokens: float | None = None, fit_rows: int = FIT_ROWS) -> Mix:
    """How often every document is taken so that each source gets its share of all tokens.

    Sizes are tokens of a public vocabulary (``vocabulary`` is a path on every machine).  Equal texts
    are one text however many ids hold them: it counts once, under its smallest id, and is repeated at
    most ``max_repeats`` times in all; the other ids get 0 copies.

    Membership: a softmax classifier over the texts' tokens, fitted on at most ``fit_rows`` labelled texts,
    gives every text a posterior over the target sources; the source a text is labelled with enters as a
    strong prior (``LABEL_PRIOR``), texts of other or null sources have none.  The whole posterior is the
    membership, in all sources (``membership``): four bytes a text and source.

    Rates between 0 and the cap (of the label; for unlabelled texts the expected one) are fitted for all
    texts by projected gradient on the squared misses of expected source tokens (``fit_rates``); the
    rounds taken and the largest miss left, as a share of the total, are reported.  Rates become whole
    copies by a fixed hash of the text: unlabelled texts, and those whose label holds less than ``DEALT`` of their
    membership, each by their own, then the texts of every label by a cut between the lower and the upper whole
    number of their rate, laid on hash bins so that what rounding left over is made up to within a bin or a text.

    ``total_tokens`` defaults to the largest total at which every source that has texts reaches its
    share under its cap, to within ``NEAR``: at least what the texts of its label alone give (``fit_largest``); shares of target sources without any text cannot be reached, are reported with 0,
    and the other shares are scaled to sum to 1 (``planned_share``).  A larger total repeats small
    sources up to their cap and reports the shares reached.

    Texts are read in the scan only: what is shuffled and checkpointed are hashes, counts and memberships.
    Null texts and texts without tokens are taken 0 times; null shares and caps count as 0 and 1;
    repeated targets are summed, with the largest cap.  Without targets or documents nothing is taken.
    When this is called, jobs run that take the sample, measure the texts once and sum their tokens, once a round beyond ``HELD_TEXTS``.
    """
    spark = documents.sparkSession
    goal = targets.select(F.col(f"`{source_col}`").alias("s"), F.col(f"`{share_col}`").cast("double").alias("share"), F.col(f"`{cap_col}`").cast("double").alias("cap")).filter("s IS NOT NULL")
    rows = goal.groupBy("s").agg(F.sum(F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.max(F.greatest(F.coalesce("cap", F.lit(1.0)), F.lit(0.0))).alias("cap")).orderBy("s").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources, n = [r.s for r in rows], len(rows)
    share, cap = np.array([r.share for r in rows]), np.floor(np.array([r.cap for r in rows]))
    docs = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("src"), F.col(f"`{text_col}`").alias("text"))
    if not n:
        return Mix(docs.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("copies")).distinct(), spark.createDataFrame([], REPORT))
    known = F.array(*[F.lit(s) for s in sources]).cast("array<string>")
    label = F.coalesce(F.array_position(known, F.col("src")), F.lit(0)).cast("int")
    read = docs.filter("text IS NOT NULL AND text <> ''").select("id", label.alias("k"), F.xxhash64(F.lit(1), "text").alias("h1"), F.xxhash64(F.lit(2), "text").alias("h2"), "text")

    # the classifier: labelled texts of the least hashes, each text once
    marked = read.filter("k > 0")
    count = marked.groupBy("k").agg(F.approx_count_distinct("h1").alias("n")).collect()
    some = max(1, sum(r.n for r in count) // (2 * fit_rows))
    picked = marked.filter(F.pmod(F.xxhash64(F.lit(9), "h1"), F.lit(some)) == 0).dropDuplicates(["h1", "h2"]).orderBy("h1", "h2").limit(fit_rows).select("k", _features(vocabulary)("text").alias("f")).collect()
    picked = [r for r in picked if r.f["at"]]
    model = Domains.fit([(r.f["at"], r.f["v"]) for r in picked], [sources[r.k - 1] for r in picked], BUCKETS) if len({r.k for r in picked}) > 1 else None
    base = np.zeros(n)
    for r in count:
        base[r.k - 1] = r.n
    base = base / base.sum() if count else np.full(n, 1 / n)

    shape = T.StructType([*_MEASURED.fields, T.StructField("id", documents.schema[id_col].dataType)])
    measured = read.mapInPandas(_measure(model, sources, base, vocabulary), shape).filter("tokens > 0")
    # one row per distinct text: a labelled source if any id has one, that of the smallest id
    lead = F.min_by(F.struct("k", "tokens", "own", "q"), F.struct(F.when(F.col("k") > 0, 0).otherwise(1).alias("soft"), F.col("id"))).alias("m")
    texts = measured.groupBy("h1", "h2").agg(lead, F.min("id").alias("first_id"))
    u = (F.pmod(F.xxhash64(F.lit(5), "h1", "h2"), F.lit(1 << 40)) / float(1 << 40)).alias("u")
    texts = checkpointed(texts.select("first_id", u, "m.k", "m.tokens", "m.own", "m.q"))

    fitted = _Texts(texts, cap)
    have, most = fitted.totals([])
    have = np.maximum(have, 1e-9)
    reach = np.zeros(n, dtype=bool)
    reach[[r.k - 1 for r in count]] = True
    reach &= most > 0
    planned = np.where(reach, share, 0.0)
    planned = planned / planned.sum() if planned.sum() else planned
    if total_tokens is None:
        # between what labels alone give for certain and what the texts of each source give at most
        alone = np.zeros(n)
        for r in texts.filter("k > 0").groupBy("k").agg(F.sum(F.col("tokens") * F.col("own")).alias("t")).collect():
            alone[r.k - 1] = r.t * cap[r.k - 1]
        limit = lambda tokens: float((tokens[planned > 0] / planned[planned > 0]).min()) if planned.any() else 0.0
        total, steps, residual = fit_largest(fitted, planned, limit(alone), limit(most), have)
    else:
        total = float(total_tokens)
        steps, residual, _ = fit_rates(fitted, planned, total, have)
    want = total * planned

    # texts drawn by their own rate first; those dealt by their label's cut make up for the rounding
    dealt = F.col("own") >= DEALT
    kind = "first_id " + shape["id"].dataType.simpleString() + ", k int, tokens bigint, q binary, copies bigint"
    mixed = texts.filter(~dealt).mapInPandas(_drawn(n, cap, steps), kind)
    hard = texts.filter(dealt)
    got = _summed(mixed.filter("copies > 0"), _given(n, cap), n)[0] + _summed(hard.select("k", "tokens", "q"), _given(n, cap, steps), n)[1]
    n_bins = max(16, min(BINS, ALL_BINS // n))
    own_bins: list[dict[int, int]] = [{} for _ in range(n)]
    for r in hard.groupBy("k", F.floor(F.col("u") * n_bins).cast("int").alias("b")).agg(F.sum(F.col("tokens") * F.col("own")).alias("t")).collect():
        own_bins[r.k - 1][r.b] = r.t
    own = np.array([float(sum(b.values())) for b in own_bins])
    rate = _rates(np.eye(n), cap, steps)
    left = np.clip(want - got, 0.0, own * cap)
    # the whole part of the fitted rate, moved only where rounding of the others leaves more or less than one copy
    floor = np.floor(np.divide(left, own, out=np.zeros(n), where=own > 0) + 1e-9)
    cuts = [_cut(own_bins[i], left[i] - floor[i] * own[i], n_bins) for i in range(n)]
    at = lambda v: F.get(F.array(*[F.lit(float(x)) for x in v]), F.col("k") - 1)
    also = F.array_contains(F.get(F.array(*[F.array(*[F.lit(b) for b in m]).cast("array<int>") for _, m in cuts]), F.col("k") - 1), F.floor(F.col("u") * n_bins).cast("int"))
    copies = F.least(at(floor) + F.when((F.col("u") < at([c for c, _ in cuts])) | also, 1).otherwise(0), at(cap)).cast("bigint")
    taken = hard.select("first_id", "k", "tokens", "q", copies.alias("copies")).unionByName(mixed)

    chosen = taken.groupBy(F.col("first_id").alias("id")).agg(F.sum("copies").alias("copies"))
    every = docs.select("id").distinct().join(chosen, "id", "left").select(F.col("id").alias(id_col), F.coalesce("copies", F.lit(0)).alias("copies"))

    per = {r.k - 1: r for r in taken.filter("k > 0").groupBy("k").agg(F.count("*").alias("n"), F.sum("tokens").alias("own"), F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.max("copies").alias("most")).collect()}
    drawn, foreign = _summed(taken.filter("copies > 0").select("k", "tokens", "q", "copies"), _given(n, cap), n)
    all_tokens = drawn.sum()
    lines = []
    for i in range(n):
        r = per.get(i)
        reached = round(float(drawn[i] / all_tokens), 9) if all_tokens else 0.0
        lines.append((sources[i], float(share[i]), float(planned[i]), r.n if r else 0, r.own if r else 0, r.t if r else 0, round(float(foreign[i]), 3), reached, round(float(rate[i]), 6), r.most if r else 0, len(steps), round(residual, 9)))
    return Mix(every, spark.createDataFrame(lines, REPORT))
