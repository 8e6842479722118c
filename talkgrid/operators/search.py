"""Full-text search and sparse inner products of a stated query set, in blocks."""

from __future__ import annotations

import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrid.functions.columns import STOP_WORDS
from talkgrid.functions.stem import parse_websearch, stem
from talkgrid.operators.vectors import top_k

K1, B = 1.2, 0.75
#: Texts and queries in one task.
ROW_BLOCK, QUERY_BLOCK = 16_384, 1_024
_FOUND = [T.StructField("score", T.DoubleType()), T.StructField("hits", T.IntegerType()), T.StructField("wanted", T.IntegerType())]


def term_hashes(text: Column) -> Column:
    """Hashes of the words of three or more letters and digits of a text, without stop words, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.transform(F.filter(found, lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t)), lambda t: F.xxhash64(t))


class Block:
    """The terms of one block of texts, inverted."""

    def __init__(self, rows: pd.DataFrame):
        self.ids = rows.id.to_numpy()
        sizes = np.array([len(t) for t in rows.t], dtype=np.int64)
        flat = np.concatenate([np.asarray(t, dtype=np.int64) for t in rows.t]) if len(rows) else np.empty(0, np.int64)
        doc = np.repeat(np.arange(len(rows)), sizes)
        order = np.lexsort((doc, flat))
        flat, doc = flat[order], doc[order]
        new = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])]) if len(flat) else np.empty(0, np.int64)
        self.term, self.doc, self.tf = flat[new], doc[new], np.diff(np.r_[new, len(flat)]).astype(np.float64)
        self.length = sizes.astype(np.float64)

    def postings(self, term: int) -> slice:
        """Where the postings of a term stand."""
        return slice(np.searchsorted(self.term, term, "left"), np.searchsorted(self.term, term, "right"))


def _best(ids: np.ndarray, score: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` best of the numbers ``among``: by score, then id."""
    if len(among) > k:
        least = np.partition(score[among], len(among) - k)[len(among) - k]
        among = among[score[among] >= least]
    return among[np.lexsort((ids[among], -score[among]))][:k]


def _scored(k: int):
    """Top ``k`` of any-term and of all-term matches of every query of a block among the texts of a block."""

    def run(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(asks):
            block = Block(rows)
            for qid, terms, weights, mean in zip(asks.qid, asks.h, asks.w, asks["mean"]):
                score, hits = np.zeros(len(block.ids)), np.zeros(len(block.ids), np.int32)
                for h, w in zip(terms, weights):
                    at = block.postings(h)
                    doc, tf = block.doc[at], block.tf[at]
                    score[doc] += w * (tf if mean != mean else tf * (K1 + 1) / (tf + K1 * (1 - B + B * block.length[doc] / mean)))
                    hits[doc] += 1
                score = np.round(score, 6)
                held, full = np.flatnonzero(hits), np.flatnonzero(hits == len(terms))
                for i in np.unique(np.concatenate([_best(block.ids, score, held, k), _best(block.ids, score, full, k)])):
                    out.append((qid, block.ids[i], score[i], hits[i], len(terms)))
        return pd.DataFrame(out, columns=["qid", "id", "score", "hits", "wanted"])

    return run


def _blocks(queries: DataFrame, docs: DataFrame, nq: int, nr: int) -> tuple[DataFrame, DataFrame]:
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    qb = queries.select("*", F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int").alias("a"), each(nr).alias("b"))
    rb = docs.select("*", each(nq).alias("a"), F.pmod(F.xxhash64("id"), F.lit(nr)).cast("int").alias("b"))
    return qb, rb


def _matches(weighted: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Best matches per block: qid, id, score, hits, wanted."""
    nq, nr = max(1, math.ceil(weighted.count() / QUERY_BLOCK)), max(1, math.ceil(docs.count() / ROW_BLOCK))
    qb, rb = _blocks(weighted, docs, nq, nr)
    shape = T.StructType([T.StructField("qid", weighted.schema["qid"].dataType), T.StructField("id", docs.schema["id"].dataType), *_FOUND])
    return rb.groupBy("a", "b").cogroup(qb.groupBy("a", "b")).applyInPandas(_scored(k), shape)


def term_rows(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row (id, t) per text with any term; an id given twice is taken once, with the least text."""
    one = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL").groupBy("id").agg(F.min("text").alias("text"))
    return one.select("id", term_hashes(F.col("text")).alias("t")).filter(F.size("t") > 0)


def bm25(queries: DataFrame, query_id: str, query_text: str, docs: DataFrame, k: int) -> DataFrame:
    """Candidates by Okapi BM25 of every query over ``docs`` (id, t): the ``k`` best of a block, and the ``k`` best with all terms.

    Document frequencies and the mean length are over all texts.  Queries and texts meet in blocks of bounded
    size, so a term that stands in most texts makes neither a hot key nor rows of its own.  Two counts run when
    this is called.
    """
    q = queries.select(F.col(query_id).alias("qid"), F.array_distinct(term_hashes(F.col(query_text))).alias("h")).filter("qid IS NOT NULL").groupBy("qid").agg(F.min("h").alias("h"))
    terms = q.select("qid", F.posexplode("h").alias("n", "x"))
    sizes = docs.agg(F.count("*").alias("n_docs"), F.avg(F.size("t")).alias("mean"))
    freq = docs.select(F.explode(F.array_distinct("t")).alias("x")).groupBy("x").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # the statistics of all texts are one row
    known = terms.join(freq, "x", "left").crossJoin(F.broadcast(sizes)).select("qid", "n", "x", F.coalesce(idf, F.lit(0.0)).alias("w"), "mean")
    own = known.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "x", "w"))).alias("s"), F.first("mean").alias("mean"))
    weighted = own.select("qid", F.transform("s", lambda s: s["x"]).alias("h"), F.transform("s", lambda s: s["w"]).alias("w"), "mean")
    return _matches(weighted, docs, k)


def search_all_terms(matches: DataFrame, k: int) -> DataFrame:
    """Texts that hold every term of the query."""
    return top_k(matches.filter("hits = wanted"), ["qid"], "score", "id", k).select("qid", "id", "score", "rank")


def search_or_fallback(matches: DataFrame, k: int) -> DataFrame:
    """All-term matches; for queries that have none, any-term matches."""
    whole = matches.groupBy("qid").agg(F.max((F.col("hits") == F.col("wanted")).cast("int")).alias("any_whole"))
    rows = matches.join(whole, "qid").filter((F.col("hits") == F.col("wanted")) | (F.col("any_whole") == 0))
    return top_k(rows, ["qid"], "score", "id", k).select("qid", "id", "score", "rank")


def sparse_search(queries: DataFrame, query_id: str, query_text: str, docs: DataFrame, k: int) -> DataFrame:
    """The ``k`` texts of largest inner product of term counts for every query, in blocks."""
    q = term_rows(queries, query_id, query_text).select(F.col("id").alias("qid"), "t")
    distinct = F.array_distinct("t")
    counts = F.transform(distinct, lambda x: F.size("t") - F.size(F.array_remove("t", x)))
    weighted = q.select("qid", distinct.alias("h"), F.transform(counts, lambda n: n.cast("double")).alias("w"), F.lit(float("nan")).alias("mean"))
    return top_k(_matches(weighted, docs, k).select("qid", "id", "score"), ["qid"], "score", "id", k)


_WORD = re.compile(r"[^\W_]+")
_STOP = frozenset(STOP_WORDS)


@lru_cache(maxsize=1 << 16)
def _stem_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(stem(word).encode(), digest_size=8).digest(), "little", signed=True)


def stem_hashes(text: str | None) -> list[int]:
    """Hashes of the stems of a text's words of any script, without stop words, in order."""
    return [_stem_hash(w) for w in _WORD.findall((text or "").lower()) if w not in _STOP]


@F.pandas_udf(T.ArrayType(T.LongType()))
def _stems(texts: pd.Series) -> pd.Series:
    return texts.map(stem_hashes)


def _contains(own: np.ndarray, phrase: list[int]) -> bool:
    at = np.flatnonzero(own[: len(own) - len(phrase) + 1] == phrase[0]) if len(own) >= len(phrase) else []
    return any(all(own[i + j] == p for j, p in enumerate(phrase)) for i in at)


def _web(k: int):
    def run(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(asks):
            block, own = Block(rows), [np.asarray(t, dtype=np.int64) for t in rows.t]
            held = lambda phrase: set.intersection(*[set(block.doc[block.postings(h)].tolist()) for h in phrase])
            match = lambda phrase: {i for i in held(phrase) if len(phrase) == 1 or _contains(own[i], phrase)}
            for qid, text in zip(asks.qid, asks.text):
                found: dict[int, float] = {}
                for wanted, unwanted in parse_websearch(text, stem_hashes):
                    among = set.intersection(*[match(p) for p in wanted])
                    for p in unwanted:
                        among -= match(p)
                    for i in among:
                        tf = sum(block.tf[s][block.doc[s] == i].sum() for s in (block.postings(h) for p in wanted for h in set(p)))
                        found[i] = max(found.get(i, 0.0), float(tf) / (1 + math.log(1 + block.length[i])))
                score = np.zeros(len(block.ids))
                score[list(found)] = list(found.values())
                for i in _best(block.ids, np.round(score, 6), np.array(sorted(found), dtype=np.int64), k):
                    out.append((qid, block.ids[i], round(score[i], 6)))
        return pd.DataFrame(out, columns=["qid", "id", "score"])

    return run


def websearch(queries: DataFrame, query_id: str, query_text: str, texts: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """Web search queries (quotes, ``OR``, minus) over stemmed words: qid, id, score, rank.

    The score is the number of wanted words a text holds over one plus the logarithm of its length.  Queries
    without words find nothing; null texts are not found; ids given twice are taken once, with the least text.
    """
    q = queries.select(F.col(query_id).alias("qid"), F.col(query_text).alias("text")).filter("qid IS NOT NULL AND text IS NOT NULL").groupBy("qid").agg(F.min("text").alias("text"))
    docs = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL").groupBy("id").agg(F.min("text").alias("text")).select("id", _stems("text").alias("t"))
    nq, nr = max(1, math.ceil(q.count() / QUERY_BLOCK)), max(1, math.ceil(docs.count() / ROW_BLOCK))
    qb, rb = _blocks(q, docs, nq, nr)
    shape = T.StructType([T.StructField("qid", q.schema["qid"].dataType), T.StructField("id", docs.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    near = rb.groupBy("a", "b").cogroup(qb.groupBy("a", "b")).applyInPandas(_web(k), shape)
    return top_k(near, ["qid"], "score", "id", k)
