"""Most similar vectors for every vector (problem 3): rotated one-bit codes in inverted lists."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrid.llm.functions.onebit import Codes, encode, rotation

#: Vectors a list holds on average; the number of lists grows with the vectors.
LIST_ROWS = 4096
#: Vectors on which the centers are fitted: so many, and so many a list if that is more (a documented bound; every row is indexed).
SAMPLE_ROWS, SAMPLE_PER_LIST = 20_000, 8
#: Vectors of one list in one task; longer lists are cut into blocks that meet pairwise.
BLOCK_ROWS = 8192
#: A vector is looked up in the lists whose center is at most so much farther (radians) than its nearest, at least and at most so many.
MARGIN, LEAST_LISTS, MOST_LISTS = 0.2, 2, 16
#: Width of the error bound in standard units; the chance of missing a vector falls as exp(-eps^2).
EPS = 3.0
#: Lists from which centers are fitted and found on two levels.
FLAT_LISTS = 512
#: Dimensions one table may mix; each has an index of its own, more are an error.
MOST_DIMENSIONS = 16
_QUERY_CHUNK = 512
#: What single precision may cost a bound.
_SLACK = 1e-5
#: Keys of vectors a task remembers to send copies once.
_SEEN_KEYS = 1 << 18


def usable(vec: Column, dim: int | None = None) -> Column:
    """Not null, all components present and finite, not all zero, and of length ``dim`` if given."""
    ok = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 3.0e38)) & F.exists(vec, lambda x: x != 0)
    return ok if dim is None else ok & (F.size(vec) == dim)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their length (scaled first, so very long vectors do not overflow)."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def fit_centers(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means on the sample."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(sample)))
    centers = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[a : a + 4096] @ centers.T).argmax(1) for a in range(0, len(sample), 4096)])
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1)
        centers[size > 1e-9] = sums[size > 1e-9] / size[size > 1e-9, None]
    return centers


@dataclass
class Centers:
    """Centers of the lists, in cells: a vector looks at the cells near it, and in them at the lists."""

    lists: np.ndarray
    cells: np.ndarray
    cell_of: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int) -> Centers:
        """Few lists in one cell; many in about their square root of cells, each fitted on its own vectors."""
        if lists <= FLAT_LISTS:
            found = _unit(fit_centers(sample, lists))
            return cls(found, _unit(found.mean(axis=0, keepdims=True) + 1e-12), np.zeros(len(found), np.int64))
        cells = _unit(fit_centers(sample, math.ceil(math.sqrt(lists))))
        own = _nearest(sample, cells)
        parts = [_unit(fit_centers(sample[own == c], max(1, round(lists * (own == c).mean())))) for c in range(len(cells)) if (own == c).any()]
        kept = np.unique(own)
        return cls(np.concatenate(parts), cells[kept], np.repeat(np.arange(len(parts)), [len(x) for x in parts]))

    def near(self, x: np.ndarray, margin: float, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, lists and places (0 the nearest) of the lists each vector is looked up in."""
        reach = np.arccos(np.clip(x @ self.cells.T, -1, 1)) if len(self.cells) > 1 else np.zeros((len(x), 1))
        inside = reach <= reach.min(axis=1, keepdims=True) + 2 * margin
        best, parts = np.full(len(x), np.inf), []
        for c in range(len(self.cells)):
            at, own = np.flatnonzero(inside[:, c]), np.flatnonzero(self.cell_of == c)
            if not len(at):
                continue
            angle = np.arccos(np.clip(x[at] @ self.lists[own].T, -1, 1))
            best[at] = np.minimum(best[at], angle.min(axis=1))
            few = min(least, len(own)) - 1
            limit = np.maximum(np.partition(angle, few, axis=1)[:, few], best[at] + margin)
            r, k = np.nonzero(angle <= limit[:, None])
            parts.append((at[r], own[k], angle[r, k]))
        row, lst, ang = (np.concatenate(z) for z in zip(*parts))
        order = np.lexsort((lst, ang, row))
        row, lst, ang = row[order], lst[order], ang[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = (place < most) & ((place < least) | (ang <= best[row] + margin))
        return row[keep], lst[keep], place[keep]


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([(rows[a : a + 4096] @ centers.T).argmax(1) for a in range(0, len(rows), 4096)])


def _packed(rows: np.ndarray) -> bytes:
    """Float rows with their bytes in planes, which the compression of the shuffle likes better."""
    return np.ascontiguousarray(rows.astype(np.float32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(blob: bytes, dim: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view(np.float32).reshape(-1, dim)


def _distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches without vectors this task has met before (it remembers ``_SEEN_KEYS``)."""
    seen: set = set()
    for pdf in batches:
        if len(seen) > _SEEN_KEYS:
            seen = set()
        keep = []
        for key in zip(pdf.h1, pdf.h2, pdf.ask):
            keep.append(key not in seen)
            seen.add(key)
        own = pdf[np.array(keep, dtype=bool)]
        if len(own):
            yield own


def _sized(centers: Centers):
    """The nearest list of every vector, to count the lists."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _distinct(batches):
            x = unit_rows(np.stack(pdf.vec.to_numpy()).astype(np.float64))
            yield pd.DataFrame({"c": centers.near(x, 0.0, 1, 1)[1].astype(np.int32), "h1": pdf.h1.to_numpy()})

    return run


_INDEX = T.StructType([T.StructField(c, T.IntegerType()) for c in ("c", "db", "qb", "role")] + [T.StructField("keys", T.BinaryType()), T.StructField("vecs", T.BinaryType())])
_FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("v1", "v2", "n1", "n2")] + [T.StructField("sim", T.DoubleType())])


def _laid(centers: Centers, blocks: dict[int, int], margin: float, least: int, most: int):
    """Vectors packed per block of a list.  Role 0: searched in, 1: searched for, 2: both."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _distinct(batches):
            raw = np.stack(pdf.vec.to_numpy()).astype(np.float32)
            keys = np.stack([pdf.h1.to_numpy(), pdf.h2.to_numpy()], axis=1).astype(np.int64)
            ask = pdf.ask.to_numpy(dtype=bool)
            x = unit_rows(raw.astype(np.float64))
            row, lst, place = centers.near(x, 0.0, 1, 1)
            if ask.any():
                r, c, p = centers.near(x[ask], margin, least, most)
                row, lst, place = np.concatenate([row, np.flatnonzero(ask)[r[p > 0]]]), np.concatenate([lst, c[p > 0]]), np.concatenate([place, p[p > 0]])
            parts: dict[tuple[int, int, int, int], list[int]] = {}
            for i, c, p in zip(row.tolist(), lst.tolist(), place.tolist()):
                nb = blocks.get(c, 1)
                b = int(keys[i, 0] % nb)
                if p == 0:
                    parts.setdefault((c, b, b, 2 if ask[i] else 0), []).append(i)
                    for o in range(nb):
                        if o != b:
                            parts.setdefault((c, b, o, 0), []).append(i)
                            if ask[i]:
                                parts.setdefault((c, o, b, 1), []).append(i)
                elif ask[i]:
                    for o in range(nb):
                        parts.setdefault((c, o, b, 1), []).append(i)
            yield pd.DataFrame([(*at, keys[own].tobytes(), _packed(raw[own])) for at, own in parts.items()], columns=_INDEX.names)

    return run


def _side(pdf: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and unit vectors of the packed rows, each key once."""
    if not len(pdf):
        return np.empty((0, 2), np.int64), np.empty((0, dim))
    keys = np.frombuffer(b"".join(pdf["keys"]), np.int64).reshape(-1, 2)
    vecs = np.concatenate([_unpacked(v, dim) for v in pdf.vecs])
    _, first = np.unique(keys, axis=0, return_index=True)
    return keys[first], unit_rows(vecs[first].astype(np.float64))


def _search(centers: Centers, rot: np.ndarray, k: int, min_sim: float, eps: float):
    """Top ``k`` of every vector searched for in one block of a list: bounds from codes, then exact cosines."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        dim = rot.shape[0]
        center = centers.lists[int(pdf.c.iloc[0])]
        ids, x = _side(pdf[pdf.role != 1], dim)
        asks, y = _side(pdf[pdf.role != 0], dim)
        if len(ids) and len(asks):
            codes = Codes(*encode(x, center, rot), center, rot, eps)
            number = {key: n for n, key in enumerate(map(tuple, ids.tolist()))}
            for a in range(0, len(asks), _QUERY_CHUNK):
                who, y_part = asks[a : a + _QUERY_CHUNK], y[a : a + _QUERY_CHUNK]
                q = codes.queries(y_part)
                high = codes.upper(q)
                own = np.array([number.get(key, -1) for key in map(tuple, who.tolist())])
                mine = np.flatnonzero(own >= 0)
                high[mine, own[mine]] = -9.0
                hit = high >= min_sim - _SLACK
                many = np.flatnonzero(hit.sum(axis=1) > 4 * k)
                if len(many) and len(ids) > k:
                    low = codes.lower(q[many])
                    low[np.isin(many, mine), own[many][own[many] >= 0]] = -9.0
                    hit[many] &= high[many] >= np.partition(low, -k, axis=1)[:, -k][:, None] - _SLACK
                qi, di = np.nonzero(hit)
                # few survivors one by one, many (no least similarity, few dimensions) as a matrix product
                dense = len(qi) * 50 >= high.size
                exact = (y_part @ x.T)[qi, di] if dense else np.einsum("ij,ij->i", y_part[qi], x[di])
                sim = np.round(exact, 7)
                fit = sim >= min_sim
                if dense and len(ids) > k:
                    # nothing below the k-th best of its row is worth sorting
                    table = np.full(high.shape, -9.0)
                    table[qi, di] = sim
                    fit &= sim >= np.partition(table, -k, axis=1)[:, -k][qi]
                qi, di, sim = qi[fit], di[fit], sim[fit]
                order = np.lexsort((ids[di, 1], ids[di, 0], -sim, qi))
                qi, di, sim = qi[order], di[order], sim[order]
                best = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
                out.append(pd.DataFrame({"v1": who[qi[best], 0], "v2": who[qi[best], 1], "n1": ids[di[best], 0], "n2": ids[di[best], 1], "sim": sim[best]}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series([], dtype="float64" if c == "sim" else "int64") for c in _FOUND.names})

    return run


def _one_dimension(vecs: DataFrame, dim: int, n: int, k: int, min_sim: float, margin: float, least: int, most: int, list_rows: int, block_rows: int, eps: float) -> DataFrame:
    """Pairs of keys (v1, v2, n1, n2, sim) among vectors of one dimension."""
    lists = max(1, math.ceil(n / list_rows))
    size = max(SAMPLE_ROWS, SAMPLE_PER_LIST * lists)
    every = max(1, n // (2 * size))
    picked = vecs.filter(F.pmod(F.xxhash64(F.lit(11), "h1"), F.lit(every)) == 0).dropDuplicates(["h1", "h2"]).limit(size).select("vec").collect()
    if not picked:
        return vecs.sparkSession.createDataFrame([], _FOUND)
    centers = Centers.fit(unit_rows(np.array([r.vec for r in picked], dtype=np.float64)).astype(np.float32), lists)
    sizes = vecs.mapInPandas(_sized(centers), "c int, h1 bigint").groupBy("c").agg(F.approx_count_distinct("h1").alias("n")).collect()
    blocks = {r.c: math.ceil(r.n / block_rows) for r in sizes if r.n > block_rows}
    laid = vecs.mapInPandas(_laid(centers, blocks, margin, least, most), _INDEX)
    return laid.groupBy("c", "db", "qb").applyInPandas(_search(centers, rotation(dim), k, min_sim, eps), _FOUND)


def nearest_vectors(
    vectors: DataFrame, id_col: str, vec_col: str, k: int = 5, min_sim: float = -1.0, ask: Column | None = None, margin: float = MARGIN, least: int = LEAST_LISTS, most: int = MOST_LISTS,
    list_rows: int = LIST_ROWS, block_rows: int = BLOCK_ROWS, eps: float = EPS,
) -> DataFrame:
    """For every vector the ``k`` others of largest cosine (at least ``min_sim``): id, neighbour, sim.

    Index: one list per ``list_rows`` vectors; list centers are fitted by k-means on ``SAMPLE_ROWS`` vectors
    (or ``SAMPLE_PER_LIST`` a list), on two levels when they are many.  Every vector is laid into the
    list of its nearest center and looked up in the lists whose center is at most ``margin`` radians
    farther than that, at least ``least`` and at most ``most``.  In a list, vectors are one-bit codes of their
    randomly rotated residual, with its length and the code's own inner product; all cosines are
    estimated from popcounts, and only vectors whose upper bound reaches ``min_sim`` and the k-th best
    lower bound are computed exactly.

    The exact vectors travel with the index, packed per list: a vector goes to its own list once, for
    both roles, and to the few others it is looked up in.  Fetching survivors by a second join on ids
    would move two vectors a surviving pair instead.

    Equal vectors are one, known by two hashes: a task sends a copy once, a list holds it once, and ids are
    added at the end, so a group of copies with a third of all rows costs one vector.  The vectors of a
    list are counted (``approx_count_distinct``); one with more than ``block_rows`` is cut into blocks that
    meet pairwise in tasks of bounded size.  ``ask`` selects the vectors to search for; all usable vectors are
    searched in.

    Null, all-zero and not finite vectors, vectors with a null component, and null ids take no part;
    vectors of another dimension have an index of their own.  Length does not matter.  An id with several
    vectors has the neighbours of each.  Equal similarities go to the smaller id.  Fewer than two
    vectors give no rows.  Ids must be of one orderable type.  When this is called, jobs run that count the
    vectors of a dimension, take the sample and count the lists.
    """
    ok = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("vec"), (F.lit(True) if ask is None else F.coalesce(ask, F.lit(False))).alias("ask")).filter(F.col("id").isNotNull() & usable(F.col("vec")))
    ok = ok.select("id", "ask", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.reverse("vec")).alias("h2"), F.size("vec").alias("d"))
    dims = ok.groupBy("d").agg(F.count("*").alias("n")).collect()
    if len(dims) > MOST_DIMENSIONS:
        raise ValueError(f"more than {MOST_DIMENSIONS} dimensions in {vec_col}")
    spark = vectors.sparkSession
    near = spark.createDataFrame([], _FOUND)
    for r in sorted(dims, key=lambda r: r.d):
        near = near.unionByName(_one_dimension(ok.filter(F.col("d") == r.d).select("h1", "h2", "ask", "vec"), r.d, r.n, k, min_sim, margin, least, most, list_rows, block_rows, eps))
    # of classes of equal vectors
    best = W.partitionBy("v1", "v2").orderBy(F.col("sim").desc(), "n1", "n2")
    near = near.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r")

    members = ok.groupBy("id", "h1", "h2").agg(F.max("ask").alias("ask"))
    # only the k + 1 smallest ids of a class can be neighbours
    place = F.row_number().over(W.partitionBy("h1", "h2").orderBy("id"))
    firsts = members.select("id", "h1", "h2").withColumn("r", place).filter(F.col("r") <= k + 1)
    copies = firsts.filter("r = 2").select(F.col("h1").alias("v1"), F.col("h2").alias("v2"), F.col("h1").alias("n1"), F.col("h2").alias("n2"), F.lit(1.0).alias("sim"))
    firsts = firsts.select(F.col("id").alias("neighbour"), F.col("h1").alias("n1"), F.col("h2").alias("n2"))
    links = near.unionByName(copies).join(firsts, ["n1", "n2"]).select("v1", "v2", "neighbour", "sim")
    asks = members.filter("ask").select("id", F.col("h1").alias("v1"), F.col("h2").alias("v2"))
    pairs = asks.join(links, ["v1", "v2"]).filter("id <> neighbour").groupBy("id", "neighbour").agg(F.max("sim").alias("sim"))
    top = W.partitionBy("id").orderBy(F.col("sim").desc(), "neighbour")
    return pairs.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= k).filter(F.col("sim") >= min_sim).select("id", "neighbour", "sim")
