"""Broken prompt and response pairs (problem 4): labelling functions and a label model a defect."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrid.llm.functions.answers import VOTES, signals
from talkgrid.llm.functions.labels import CUTOFFS, DEFECTS, label_model
from talkgrid.llm.functions.languages import Languages
from talkgrid.session import checkpointed

#: Labelled texts on which the letter groups of the languages are trained, at most (of the least id hash).
LANGUAGE_TEXTS = 3000


def trained_languages(texts: DataFrame, id_col: str, lang_col: str, text_col: str, rows: int = LANGUAGE_TEXTS) -> Languages | None:
    """Letter groups of the languages of labelled texts, from at most ``rows`` of them.

    Two jobs: the labelled rows are counted, then about twice ``rows`` of them, chosen by a hash of the id, are
    looked at, however many there are.

    A label is read up to its region (``en-US`` is ``en``); null and undetermined ones take no part.
    """
    lang = F.lower(F.split(F.trim(F.col(f"`{lang_col}`")), "[-_]")[0])
    marked = texts.select(F.xxhash64(F.col(f"`{id_col}`")).alias("h"), lang.alias("lang"), F.col(f"`{text_col}`").alias("text")).filter("lang IS NOT NULL AND lang NOT IN ('und', '') AND text IS NOT NULL")
    every = max(1, marked.select("h").count() // (2 * rows))
    some = marked.filter(F.pmod(F.col("h"), F.lit(every)) == 0)
    return Languages.fit([(r.lang, r.text) for r in some.orderBy("h", "text").limit(rows).collect()])


def _signals(languages: Languages | None):
    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def run(question: pd.Series, answer: pd.Series, abstain: pd.Series, parse_ok: pd.Series, raw: pd.Series) -> pd.Series:
        flag = lambda v: None if v is None or v != v else bool(v)
        return pd.Series([signals(q, a, flag(b), flag(p), r, languages) for q, a, b, p, r in zip(question, answer, abstain, parse_ok, raw)])

    return run


def defective_pairs(pairs: DataFrame, keys: list[str], question: str, answer: str, abstain: str, parse_ok: str, raw: str, cutoffs: dict[str, float] | None = None, languages: Languages | None = None) -> DataFrame:
    """Every pair with each defect whose posterior reaches its cutoff: keys, defect, posterior.

    Defects: empty, truncated, refusal, copy (of the question), language (other than the question's).
    Where ``parse_ok`` is false the answer is taken from the raw response.  Each defect has its own
    labelling functions, among them, for the language, the letter groups of ``languages``; only the counts of their firing patterns (at most 2^5 a defect, whatever the
    number of rows) reach the driver, where the label model is fitted over all rows; the
    posteriors return as a lookup in the plan.  A pair may carry several defects.

    One row per key is expected; rows with a null key are kept under it.  A null answer is empty; a
    null question can be neither copied nor of another language; null flags say nothing; an empty
    table gives no rows.
    """
    cut = CUTOFFS | (cutoffs or {})
    col = lambda c: F.col(f"`{c}`")
    fired = pairs.select(*[col(k) for k in keys], _signals(languages)(col(question), col(answer), col(abstain), col(parse_ok), col(raw)).alias("__f"))
    parts, labelled = {}, fired
    for d in DEFECTS:
        at = [i for i, v in enumerate(VOTES) if v[0] == d]
        parts[d] = at
        code = sum((F.when(F.col("__f")[i], 1 << j).otherwise(0) for j, i in enumerate(at)), F.lit(0))
        labelled = labelled.withColumn(f"__{d}", code)
    # keys and small numbers only; the texts are looked at once
    labelled = checkpointed(labelled.drop("__f"))
    # one small row per defect and pattern
    stacked = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"__{d}").alias("code")) for d in DEFECTS])).alias("p")
    seen = labelled.select(stacked).groupBy("p.d", "p.code").agg(F.count("*").alias("n")).collect()
    kept = []
    for d in DEFECTS:
        own = [r for r in seen if r.d == d]
        if not own:
            continue
        at = parts[d]
        fires = np.array([[r.code >> j & 1 for j in range(len(at))] for r in own])
        post = label_model(fires, np.array([r.n for r in own]), [VOTES[i][2] for i in at])
        kept += [F.struct(F.lit(d).alias("d"), F.lit(int(r.code)).alias("code"), F.lit(float(p)).alias("p")) for r, p in zip(own, post) if p >= cut[d]]
    if not kept:
        return labelled.select(*[col(k) for k in keys], F.lit("").alias("defect"), F.lit(0.0).alias("posterior")).filter(F.lit(False))
    mine = F.map_from_entries(F.array(*[F.struct(F.lit(d).alias("key"), F.col(f"__{d}").alias("value")) for d in DEFECTS]))
    out = labelled.withColumn("__codes", mine).withColumn("__hit", F.explode(F.filter(F.array(*kept), lambda s: F.col("__codes")[s["d"]] == s["code"])))
    return out.select(*[col(k) for k in keys], F.col("__hit.d").alias("defect"), F.col("__hit.p").alias("posterior"))
