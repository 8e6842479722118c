"""Evaluation texts leaking into training text (problem 8), by winnowed fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrid.llm.functions.passages import gram_hashes, longest_common_run, passage_words, winnow
from talkgrid.operators.skew import salted_join
from talkgrid.session import checkpointed
from talkgrid.tables import small

#: A leak is at least this many consecutive words.
SHARED_WORDS = 12
#: Words in a fingerprinted gram; with it a window holds SHARED_WORDS - GRAM_WORDS + 1 grams.
GRAM_WORDS = 6
#: Characters of all items up to which they are held in every task; counted before anything is sent.
HELD_CHARS = 16_000_000


class Items:
    """The items of one task: their words, grams and fingerprints."""

    def __init__(self, rows: list[tuple], k: int, window: int):
        self.k, self.window = k, window
        self.ids = [i for i, _ in rows]
        self.words = [passage_words(t) for _, t in rows]
        self.grams = [gram_hashes(w, k) for w in self.words]
        prints = [np.unique(g[winnow(g, window)]) for g in self.grams]
        owner = np.repeat(np.arange(len(rows)), [len(p) for p in prints])
        every = np.concatenate(prints) if prints else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.prints, self.owner = every[order], owner[order]

    def hits(self, prints: np.ndarray) -> np.ndarray:
        """Numbers of the items that share a fingerprint."""
        low, high = np.searchsorted(self.prints, prints, "left"), np.searchsorted(self.prints, prints, "right")
        at = np.flatnonzero(high > low)
        return np.unique(np.concatenate([self.owner[low[i] : high[i]] for i in at])) if len(at) else at

    def leaks(self, text: str, least: int) -> list[tuple]:
        """(item, words, at) of every item the text shares ``least`` words with."""
        w = passage_words(text)
        g = gram_hashes(w, self.k)
        out = []
        for m in self.hits(g[winnow(g, self.window)]).tolist():
            n, at = longest_common_run(w, self.words[m], g, self.grams[m], self.k)
            if n >= least:
                out.append((self.ids[m], n, at))
        return out


#: The items last used in this process, with the rows they were made of.
_LAST: list[tuple] = []


def _held_items(rows: list[tuple], k: int, window: int) -> Items:
    """The items of broadcast rows, prepared once a process rather than once a task."""
    if not _LAST or _LAST[0][0] is not rows or _LAST[0][1:3] != (k, window):
        _LAST[:] = [(rows, k, window, Items(rows, k, window))]
    return _LAST[0][3]


def _in_pass(rows, k: int, window: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = _held_items(rows.value, k, window)
        for pdf in batches:
            found = [(d, *leak) for d, text in zip(pdf.d, pdf.dt) for leak in items.leaks(text, least)]
            yield pd.DataFrame(found, columns=["d", "i", "words", "at"])

    return run


def _of_pairs(k: int, window: int, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for text, own in pdf.groupby("dt", sort=False):
                found += [(d, i, n, at) for d, i, it in zip(own.d, own.i, own.it) for i, n, at in Items([(i, it)], k, window).leaks(text, least)]
            yield pd.DataFrame(found, columns=["d", "i", "words", "at"])

    return run


def fingerprints(k: int, window: int):
    """Column function: distinct fingerprints of a text as ``array<bigint>``; null text gives none."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def prints(texts: pd.Series) -> pd.Series:
        def one(text):
            h = gram_hashes(passage_words(text), k)
            return np.unique(h[winnow(h, window)]).view(np.int64)

        return texts.map(one)

    return prints


def leaked_passages(documents: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, shared_words: int = SHARED_WORDS, gram_words: int = GRAM_WORDS, held_chars: int = HELD_CHARS) -> DataFrame:
    """Pairs of a document and an item that share a run of at least ``shared_words`` words.

    Texts are read as words without case, punctuation, line breaks, markup and time codes.  Both sides
    keep the least hash of every window of ``shared_words - gram_words + 1`` grams of ``gram_words``
    words, which guarantees a common fingerprint for every shared run that is long enough.  Hits are
    extended word by word on the whole texts, so hash collisions leave no trace.

    The characters of the items are counted first (one job over them).  Up to ``held_chars`` every task
    holds all items: documents are read once, fingerprinted and extended in the same pass, and no text and
    no fingerprint is shuffled.  Beyond, fingerprints are joined, one that many documents hold in salts;
    only the ids of documents with a hit are kept, and the documents are read a second time
    for those (joined by a broadcast of the ids while they are few, else by a shuffle of the texts).

    Output: doc_id, item_id, words (longest shared run), at (its first word in the document).
    Null or shorter texts share nothing; rows with a null id take no part; an id given twice is
    taken with each of its texts and reported once with the longest run; empty tables give no rows.
    """
    window = shared_words - gram_words + 1
    if window < 1 or gram_words < 1:
        raise ValueError("gram_words must lie between 1 and shared_words")
    spark = documents.sparkSession
    docs = documents.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{doc_text}`").alias("dt")).filter("d IS NOT NULL AND dt IS NOT NULL")
    held = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("it")).filter("i IS NOT NULL AND it IS NOT NULL")
    out = T.StructType([T.StructField("d", documents.schema[doc_id].dataType), T.StructField("i", items.schema[item_id].dataType), T.StructField("words", T.IntegerType()), T.StructField("at", T.IntegerType())])
    chars = held.agg(F.sum(F.length("it") + 16)).first()[0] or 0
    if chars <= held_chars:
        rows = spark.sparkContext.broadcast([(r.i, r.it) for r in held.distinct().collect()])
        runs = docs.mapInPandas(_in_pass(rows, gram_words, window, shared_words), out)
    else:
        prints = fingerprints(gram_words, window)
        item_prints = held.select("i", F.explode(prints("it")).alias("h")).distinct()
        doc_prints = docs.select("d", F.explode(prints("dt")).alias("h")).distinct()
        hits = checkpointed(salted_join(item_prints, doc_prints, ["h"], "d").select("d", "i").distinct())
        pairs = docs.join(small(hits), "d").join(held, "i").select("d", "i", "dt", "it")
        runs = pairs.mapInPandas(_of_pairs(gram_words, window, shared_words), out)
    best = F.max(F.struct("words", (-F.col("at")).alias("at"))).alias("m")
    return runs.groupBy("d", "i").agg(best).select(F.col("d").alias(doc_id), F.col("i").alias(item_id), F.col("m.words").alias("words"), (-F.col("m.at")).alias("at"))
