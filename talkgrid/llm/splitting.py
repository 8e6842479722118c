"""Splitting oversized items at natural boundaries (problem 6)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrid.llm.functions.splitting import split_text
from talkgrid.tables import small


def count_tokens(text: Column) -> Column:
    """Runs of characters other than space, tab and line break; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\r\\n]+")), F.lit(0))


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, k, *piece) for i, text, m, o in zip(pdf.id, pdf.text, pdf.m, pdf.o) for k, piece in enumerate(split_text(text, int(m), int(o)))]
        yield pd.DataFrame(rows, columns=["id", "piece_no", "first_token", "overlap", "tokens", "text"])


def split_oversized(items: DataFrame, limits: DataFrame, item_id: str, kind: str, text: str, max_tokens: str, overlap_tokens: str) -> DataFrame:
    """Pieces of every item whose text holds more tokens than the limit of its kind allows.

    Cuts follow the content: a rolling hash over the words marks landmarks, the first landmark behind
    a quarter of the room snaps to the nearest end of a paragraph (else sentence, line, clause) within
    minimum and maximum size, so an edit alters neighbouring pieces only.  Without a landmark the last
    boundary that fits is taken, without any boundary the landmark itself or the limit.  Every piece but
    the first begins with the last ``overlap_tokens`` tokens of the one before; with them it is
    within ``max_tokens``.  Texts are cut where they stand: a piece is a substring of its text.

    Output: item_id, piece_no (from 0), first_token (first new token), overlap, tokens, text.
    Items within their limit, with a null text or id, or of a kind without a limit give no pieces
    (they are whole already); tokens are counted, never taken from a column.  An overlap that is null
    or negative counts as 0, one of at least the limit as limit - 1; a limit below 1 as 1.  Repeated
    rows with the same id and text count once; empty tables give no rows.

    The token count and the limit test run in the JVM; only oversized texts reach Python, in Arrow
    batches, without a shuffle of the texts that fit.
    """
    lim = limits.select(F.col(f"`{kind}`").alias("k"), F.greatest(F.col(f"`{max_tokens}`").cast("int"), F.lit(1)).alias("m"), F.coalesce(F.col(f"`{overlap_tokens}`").cast("int"), F.lit(0)).alias("o0"))
    lim = lim.filter("k IS NOT NULL AND m IS NOT NULL").groupBy("k").agg(F.min("m").alias("m"), F.max("o0").alias("o0"))
    lim = lim.select("k", "m", F.greatest(F.lit(0), F.least(F.col("o0"), F.col("m") - 1)).alias("o"))
    rows = items.select(F.col(f"`{item_id}`").alias("id"), F.col(f"`{kind}`").alias("k"), F.col(f"`{text}`").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    over = rows.join(small(lim), "k").filter(count_tokens(F.col("text")) > F.col("m")).select("id", "text", "m", "o").distinct()
    out = T.StructType(
        [T.StructField("id", items.schema[item_id].dataType), *[T.StructField(c, T.IntegerType()) for c in ("piece_no", "first_token", "overlap", "tokens")], T.StructField("text", T.StringType())]
    )
    return over.mapInPandas(_split, out).withColumnRenamed("id", item_id)
