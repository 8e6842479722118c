"""Exact vector search: cosine and late-interaction scores of a stated query set, in blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_BLOCK = 16_384
QUERY_BLOCK = 1_024
#: Queries whose candidates are scored in one task.
QUERIES_PER_TASK = 64


def finite_vector(vec: Column) -> Column:
    """Not null, every component finite, and not all zero."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 3.0e38)) & F.exists(vec, lambda x: x != 0)


def top_k(df: DataFrame, groups: list[str], score: str, tie: str, k: int, rank: str = "rank") -> DataFrame:
    """The ``k`` best rows of each group (score descending, then ``tie`` ascending), ranked from 1."""
    w = W.partitionBy(*groups).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def _scores(tokens: int, k: int, digits: int):
    """Top ``k`` rows of a block for every query of a block, by the sum over query tokens of the best token."""

    def run(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asks):
            return pd.DataFrame({"qid": asks.qid.iloc[:0], "id": rows.id.iloc[:0], "score": pd.Series([], dtype="float64")})
        x = np.array(rows.vec.tolist(), dtype=np.float64)
        y = np.array(asks.vec.tolist(), dtype=np.float64)
        if tokens == 1:
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            y /= np.linalg.norm(y, axis=1, keepdims=True)
            sim = y @ x.T
        else:
            xt, yt = x.reshape(len(x), tokens, -1), y.reshape(len(y), tokens, -1)
            sim = np.zeros((len(y), len(x)))
            for i in range(tokens):
                best = np.full((len(y), len(x)), -np.inf)
                for j in range(tokens):
                    np.maximum(best, yt[:, i] @ xt[:, j].T, out=best)
                sim += best
        sim = np.round(sim, digits)
        ids = rows.id.to_numpy()
        out = []
        for q, row in zip(asks.qid, sim):
            if len(row) > k:
                least = np.partition(row, len(row) - k)[len(row) - k]
                at = np.flatnonzero(row >= least)
                at = at[np.lexsort((ids[at], -row[at]))][:k]
            else:
                at = np.arange(len(row))
            out.append(pd.DataFrame({"qid": q, "id": ids[at], "score": row[at]}))
        return pd.concat(out)

    return run


def exact_search(queries: DataFrame, rows: DataFrame, k: int, tokens: int = 1, digits: int = 6) -> DataFrame:
    """The ``k`` rows of highest score for every query: qid, id, score, rank.

    ``queries`` (qid, vec) and ``rows`` (id, vec) are laid into blocks of bounded size; every block of
    queries meets every block of rows in one task as a matrix product and keeps its own best, which are
    merged by rank.  ``tokens`` = 1 scores by cosine; otherwise a vector is that many tokens end to end
    and the score is the sum over query tokens of the best inner product.

    Null, zero and not finite vectors take no part; ids given twice are taken once (least vector);
    equal scores (to ``digits``) go to the smaller id; vectors must have one dimension.
    """
    q = queries.filter(finite_vector(F.col("vec")) & F.col("qid").isNotNull()).groupBy("qid").agg(F.min("vec").alias("vec"))
    r = rows.filter(finite_vector(F.col("vec")) & F.col("id").isNotNull()).groupBy("id").agg(F.min("vec").alias("vec"))
    nq, nr = max(1, math.ceil(q.count() / QUERY_BLOCK)), max(1, math.ceil(r.count() / ROW_BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    qb = q.select("qid", "vec", F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int").alias("a"), each(nr).alias("b"))
    rb = r.select("id", "vec", each(nq).alias("a"), F.pmod(F.xxhash64("id"), F.lit(nr)).cast("int").alias("b"))
    shape = T.StructType([T.StructField("qid", q.schema["qid"].dataType), T.StructField("id", r.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    near = rb.groupBy("a", "b").cogroup(qb.groupBy("a", "b")).applyInPandas(_scores(tokens, k, digits), shape)
    return top_k(near, ["qid"], "score", "id", k)


def _interact(digits: int):
    """Sum over a query's tokens of the best inner product with any token of a candidate, for the candidates of some queries."""

    def run(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asks):
            dim = len(asks.vec.iloc[0])
            asks, rows = asks.sort_values(["qid", "position"], kind="stable"), rows.sort_values(["qid", "id"], kind="stable")
            query, who = np.stack(asks.vec.to_numpy()).astype(np.float64), asks.qid.to_numpy()
            qids, ids = rows.qid.to_numpy(), rows.id.to_numpy()
            counts = np.array([len(t) // dim for t in rows.flat])
            tokens = np.concatenate(list(rows.flat)).astype(np.float64).reshape(-1, dim)
            upto = np.r_[0, np.cumsum(counts)]
            for qid in np.unique(qids):
                a, b = np.searchsorted(qids, qid, "left"), np.searchsorted(qids, qid, "right")
                q = query[np.searchsorted(who, qid, "left") : np.searchsorted(who, qid, "right")]
                if not len(q):
                    continue
                own, first = np.unique(ids[a:b], return_index=True)
                best = np.maximum.reduceat(tokens[upto[a] : upto[b]] @ q.T, upto[a + first] - upto[a], axis=0)
                out.append(pd.DataFrame({"qid": qid, "id": own, "score": np.round(best.sum(axis=1), digits)}))
        return pd.concat(out) if out else pd.DataFrame({"qid": rows.qid.iloc[:0], "id": rows.id.iloc[:0], "score": pd.Series([], dtype="float64")})

    return run


def late_interaction(candidates: DataFrame, query_tokens: DataFrame, tokens: DataFrame, by_part: bool = False, digits: int = 6) -> DataFrame:
    """Late interaction scores (qid, id, score) of candidates (qid, id), or with ``by_part`` (qid, id, part) whose tokens are those of all parts.

    ``query_tokens`` (qid, position, vec) and ``tokens`` (id, position, vec; with ``by_part`` id is the part) are token tables of
    one dimension.  The tokens of a text lie in one row; the candidates of ``QUERIES_PER_TASK`` queries, which a
    prefilter bounds, meet their queries' tokens in one task as matrix products.  ``query_tokens`` holds the asking queries only.  Candidates without tokens are not
    scored.  One count of the queries runs when this is called.
    """
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", "vec"))), lambda s: s["vec"]))
    held = tokens.groupBy("id").agg(flat.alias("flat"))
    rows = candidates.join(held.withColumnRenamed("id", "part"), "part").select("qid", "id", "flat") if by_part else candidates.join(held, "id").select("qid", "id", "flat")
    groups = max(1, math.ceil(query_tokens.select("qid").distinct().count() / QUERIES_PER_TASK))
    group = F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int").alias("g")
    shape = T.StructType([T.StructField("qid", candidates.schema["qid"].dataType), T.StructField("id", candidates.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    return rows.select("*", group).groupBy("g").cogroup(query_tokens.select("*", group).groupBy("g")).applyInPandas(_interact(digits), shape)


def mean_pool(df: DataFrame, key: str, vec: str, dim: int | None = None) -> DataFrame:
    """Mean of the vectors of each key, component by component: one average a component, with map-side combine.

    ``dim`` defaults to that of the first vector; vectors of another dimension take no part.
    """
    first = dim or df.filter(F.col(vec).isNotNull()).select(F.size(vec).alias("d")).limit(1).collect()[0].d
    own = df.filter(F.size(vec) == first)
    means = own.groupBy(key).agg(*[F.avg(F.get(F.col(vec), F.lit(i)).cast("double")).alias(f"__{i}") for i in range(first)])
    return means.select(key, F.array(*[f"__{i}" for i in range(first)]).alias("pooled"))
