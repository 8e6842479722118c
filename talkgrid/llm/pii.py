"""Personal information inside free text (problem 10)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrid.llm.functions.pii import Seeds, details, redact

#: Given names taken to every task at most; more is an error, not a silent cut.
MAX_GIVEN_NAMES = 200_000
_DETAIL = T.StructType([T.StructField("pii_type", T.StringType()), T.StructField("value", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("score", T.DoubleType())])


def _scan(given: frozenset[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = Seeds(given)
        for pdf in batches:
            found, clean = [], []
            for text in pdf.text:
                own = details(text, seeds)
                found.append([(f.kind, text[f.start : f.end], f.start, f.score) for f in own])
                clean.append(redact(text, own))
            yield pd.DataFrame({"id": pdf.id, "found": found, "redacted": clean})

    return run


def personal_details(documents: DataFrame, id_col: str, text_col: str, given_names: DataFrame | None = None, name_col: str = "given_name") -> DataFrame:
    """Per document its personal details and its text with typed placeholders.

    Output: id, found (array of pii_type, value, start, score in order of their place), redacted.

    Regular expressions propose spans for email, phone, id_number, address and name; checksums
    (Luhn, modulo 97, ISO 7064, check letters and weights) confirm identity numbers; words beside a
    span add to or take from its score; spans over their threshold stay, of overlapping ones the surer.
    Given names seen at registration help names but are not needed.  Values stand as written.

    The whole text is read, once, in one pass of Arrow batches without any shuffle; the given names
    (an error beyond ``MAX_GIVEN_NAMES``) go to every task.  A null or empty text has no details
    and stays as it is; rows with a null id are kept; repeated rows are repeated; other columns are
    ignored.
    """
    given: frozenset[str] = frozenset()
    if given_names is not None:
        rows = given_names.select(F.lower(F.trim(F.col(f"`{name_col}`"))).alias("n")).filter("n <> ''").distinct().limit(MAX_GIVEN_NAMES + 1).collect()
        if len(rows) > MAX_GIVEN_NAMES:
            raise ValueError(f"more than {MAX_GIVEN_NAMES} given names")
        given = frozenset(r.n for r in rows)
    out = T.StructType([T.StructField("id", documents.schema[id_col].dataType), T.StructField("found", T.ArrayType(_DETAIL)), T.StructField("redacted", T.StringType())])
    return documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInPandas(_scan(given), out).withColumnRenamed("id", id_col)
