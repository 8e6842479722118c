"""A bounded answer loop over a batch of queries, with injected models, and checks of model output."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrid.operators.fusion import reciprocal_rank_fusion
from talkgrid.operators.vectors import top_k
from talkgrid.session import checkpointed

#: A model step takes a DataFrame and gives it back with a column more.
Step = Callable[[DataFrame], DataFrame]


def strip_fence(raw: Column) -> Column:
    """Text inside one code fence, else the text."""
    inner = F.regexp_extract(raw, r"(?is)^\s*```(?:json)?\s*(.*?)\s*```\s*$", 1)
    return F.when(inner != "", inner).otherwise(raw)


def first_object(raw: Column) -> Column:
    """From the first opening to the last closing brace, or null."""
    found = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def confidence(raw: Column, default: float = 0.5) -> Column:
    """``confidence`` of a judge's JSON clamped to [0, 1]; the default when it cannot be read."""
    v = F.try_variant_get(F.try_parse_json(first_object(strip_fence(raw))), "$.confidence", "double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(v, F.lit(default))))


def literal_true(raw: Column, path: str) -> Column:
    """Whether the JSON value at the path is the literal ``true``; strings and numbers do not count."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), path, "variant"))
    value = F.try_variant_get(F.try_parse_json(raw), path, "boolean")
    return F.coalesce((kind == "BOOLEAN") & value, F.lit(False))


def aligned_flags(judgements: DataFrame, key: str, raw: str, size: str, list_name: str = "claims", index: str = "index", flag: str = "grounded") -> DataFrame:
    """Judged flags by declared index: key, position, flag.

    Entries outside ``0 .. size - 1`` are ignored, later entries for one index win, unseen positions are
    false, and only the JSON literal ``true`` is true.
    """
    items = F.try_variant_get(F.try_parse_json(F.col(raw)), f"$.{list_name}", "array<variant>")
    wanted = judgements.filter(F.col(size) > 0).select(F.col(key), F.explode(F.sequence(F.lit(0), F.col(size) - 1)).alias("position"))
    said = judgements.select(F.col(key), F.posexplode(items).alias("n", "v"))
    at = F.try_variant_get("v", f"$.{index}", "int").alias("position")
    kind = F.schema_of_variant(F.try_variant_get("v", f"$.{flag}", "variant"))
    yes = F.coalesce((kind == "BOOLEAN") & F.try_variant_get("v", f"$.{flag}", "boolean"), F.lit(False)).alias("yes")
    last = said.select(key, "n", at, yes).groupBy(key, "position").agg(F.max_by("yes", "n").alias("yes"))
    return wanted.join(last, [key, "position"], "left").select(key, "position", F.coalesce("yes", F.lit(False)).alias(flag))


def valid_citations(answers: DataFrame, chunks: DataFrame, least: float = 0.5) -> DataFrame:
    """Citations with the retrieved chunk of the same query and video that covers most of them.

    ``answers``: qid, n_claims, citations array<struct<claim int, video_id, start_sec, end_sec>>;
    ``chunks``: qid, chunk_id, rank, video_id, start_sec, end_sec.  A claim index outside the claims, a
    span without length or a cover below ``least`` makes a citation invalid; of equal covers the better
    rank counts.
    """
    c = answers.select("qid", "n_claims", F.posexplode("citations").alias("n", "c")).select("qid", "n_claims", "n", F.col("c.claim").alias("claim"), F.col("c.video_id").alias("video_id"), F.col("c.start_sec").alias("s"), F.col("c.end_sec").alias("e"))
    length = F.col("e") - F.col("s")
    share = F.when(length > 0, F.greatest(F.lit(0.0), F.least("e", "end_sec") - F.greatest("s", "start_sec")) / length).otherwise(0.0)
    best = c.join(chunks, ["qid", "video_id"]).groupBy("qid", "n").agg(F.max_by(F.struct("chunk_id", share.alias("share")), F.struct(share, -F.col("rank"), -F.col("chunk_id"))).alias("m"))
    out = c.join(best, ["qid", "n"], "left")
    reason = F.when((F.col("claim") < 0) | (F.col("claim") >= F.col("n_claims")) | F.col("claim").isNull(), "claim index").when(length <= 0, "empty span").when(F.coalesce(F.col("m.share"), F.lit(0.0)) < least, "no chunk")
    return out.select("qid", "n", "claim", F.col("m.chunk_id").alias("chunk_id"), F.round(F.coalesce(F.col("m.share"), F.lit(0.0)), 6).alias("share"), reason.alias("reason"))


@dataclass
class Loop:
    """Retrieve, fuse, rerank and verify until the judge is confident, at most ``1 + max_rounds`` times.

    ``channels`` map (qid, query) to (qid, chunk_id, rank); ``rerank`` adds ``score`` to (qid, query,
    chunk_id); ``judge`` maps (qid, query, chunks) to (qid, raw).  All queries of a batch go through
    one plan per round; only those below the threshold enter the next, with the refined query if the
    judge gave one.  Every round is checkpointed, so the plan does not grow.
    """

    channels: dict[str, Step]
    rerank: Step
    judge: Step
    threshold: float = 0.6
    max_rounds: int = 2
    fuse_top: int = 30
    keep: int = 8
    shown: int = 3
    spans: list[tuple[int, str]] = field(default_factory=list)

    def run(self, queries: DataFrame) -> DataFrame:
        """qid, query, round, confidence, chunk_id, rank of the last round of every query."""
        open_now, done = queries.select("qid", "query"), None
        for n in range(self.max_rounds + 1):
            lists = None
            for name, channel in self.channels.items():
                rows = channel(open_now).select("qid", "chunk_id", "rank", F.lit(name).alias("channel"))
                lists = rows if lists is None else lists.unionByName(rows)
                self.spans.append((n, name))
            fused = reciprocal_rank_fusion(lists, "qid", "chunk_id", "channel", "rank", top=self.fuse_top).select("qid", "chunk_id")
            scored = self.rerank(fused.join(open_now, "qid")).select("qid", "chunk_id", "score")
            best = top_k(scored, ["qid"], "score", "chunk_id", self.keep)
            head = best.filter(F.col("rank") <= self.shown).groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunks"))
            judged = self.judge(open_now.join(head, "qid", "left")).select("qid", "raw")
            state = open_now.join(judged, "qid", "left").select("qid", "query", confidence(F.col("raw")).alias("confidence"), F.trim(F.try_variant_get(F.try_parse_json(first_object(strip_fence(F.col("raw")))), "$.refined_query", "string")).alias("refined"))
            state = checkpointed(state.join(best.select("qid", "chunk_id", "rank"), "qid", "left").withColumn("round", F.lit(n)))
            again = (F.col("confidence") < self.threshold) if n < self.max_rounds else F.lit(False)
            ended = state.filter(~again)
            done = ended if done is None else done.unionByName(ended)
            open_now = checkpointed(state.filter(again).select("qid", F.when(F.coalesce(F.col("refined"), F.lit("")) != "", F.col("refined")).otherwise(F.col("query")).alias("query")).distinct())
            if n < self.max_rounds and open_now.isEmpty():
                break
        return done.select("qid", "query", "round", "confidence", "chunk_id", "rank")


def trace_spans(spans: DataFrame, trace: str, span: str, parent: str, begun: str, ended: str) -> DataFrame:
    """Latency of every span and the part of it that no child covers: trace, span, ms, own_ms."""
    ms = (F.unix_millis(F.col(ended)) - F.unix_millis(F.col(begun))).alias("ms")
    own = spans.select(F.col(trace).alias("trace"), F.col(span).alias("span"), F.col(parent).alias("parent"), ms)
    kids = own.filter("parent IS NOT NULL").groupBy("trace", F.col("parent").alias("span")).agg(F.sum("ms").alias("child_ms"))
    return own.join(kids, ["trace", "span"], "left").select("trace", "span", "ms", (F.col("ms") - F.coalesce("child_ms", F.lit(0))).alias("own_ms"))


def uuid7(millis: Column) -> Column:
    """A version 7 UUID string: 48 bits of milliseconds, then random bits with version and variant set."""
    head = F.lpad(F.lower(F.hex(millis)), 12, "0")
    rand = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return F.concat_ws("-", F.substring(head, 1, 8), F.substring(head, 9, 4), F.concat(F.lit("7"), F.substring(rand, 1, 3)), F.substring(rand, 17, 4), F.substring(rand, 21, 12))
