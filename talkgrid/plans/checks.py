"""Queries that validate gold records and the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.plans.registry import Registry
from talkgrid.tables import table

R = Registry()

#: Modalities of gold records, and those seen rather than heard.
MODALITIES = ("transcript", "slide", "screen_code", "diagram", "whiteboard", "audio_only")
VISUAL_MODALITIES = ("slide", "screen_code", "diagram", "whiteboard")
_LIST = ", ".join(f"'{m}'" for m in MODALITIES)
_SINGLE, _SYNTHESIS, _NEGATIVE = "question_type = 'single_clip'", "question_type = 'synthesis'", "question_type = 'negative'"
#: Rule -> condition that breaks it.  ``{n:x}`` stands for the number of items of an array (0 for null), ``{any:x:cond}`` for
#: an item ``i`` of it that meets a condition; the rest is plain SQL.
RULES = {
    "required": "id IS NULL OR question IS NULL OR split IS NULL OR question_type IS NULL OR modality IS NULL OR difficulty IS NULL OR verified IS NULL OR curator IS NULL OR curated_at IS NULL",
    "id_pattern": "NOT {like:id:^[a-z0-9_-]+$}",
    "question_short": "length(question) < 15",
    "split": "split NOT IN ('dev', 'test')",
    "question_type": "question_type NOT IN ('single_clip', 'synthesis', 'negative')",
    "negative_scope": "negative_scope NOT IN ('video', 'corpus')",
    "span_before_zero": "{any:gold_spans:i.start_sec < 0 OR i.end_sec < 0}",
    "span_without_bounds": "{any:gold_spans:i.start_sec IS NULL OR i.end_sec IS NULL}",
    "span_backwards": "{any:gold_spans:i.end_sec <= i.start_sec}",
    "claim_short": "{any:expected_claims:length(i) < 10}",
    "modality_empty": "modality IS NOT NULL AND {n:modality} = 0",
    "modality": "{any:modality:i NOT IN (" + _LIST + ")}",
    "difficulty": "difficulty NOT IN ('easy', 'medium', 'hard')",
    "curator_empty": "curator = ''",
    "single_parts": f"{_SINGLE} AND (video_id IS NULL OR gold_spans IS NULL OR expected_claims IS NULL)",
    "single_spans": f"{_SINGLE} AND gold_spans IS NOT NULL AND {{n:gold_spans}} <> 1",
    "synthesis_parts": f"{_SYNTHESIS} AND (gold_spans IS NULL OR expected_claims IS NULL)",
    "synthesis_video": f"{_SYNTHESIS} AND video_id IS NOT NULL",
    "synthesis_spans": f"{_SYNTHESIS} AND gold_spans IS NOT NULL AND {{n:gold_spans}} < 2",
    "synthesis_span_video": f"{_SYNTHESIS} AND {{any:gold_spans:i.video_id IS NULL}}",
    "positive_abstains": f"({_SINGLE} OR {_SYNTHESIS}) AND abstention_expected",
    "negative_scope_missing": f"{_NEGATIVE} AND negative_scope IS NULL",
    "negative_spans": f"{_NEGATIVE} AND {{n:gold_spans}} > 0",
    "negative_answers": f"{_NEGATIVE} AND (NOT abstention_expected OR expected_answer IS NOT NULL)",
    "negative_video_missing": f"{_NEGATIVE} AND negative_scope = 'video' AND video_id IS NULL",
    "negative_corpus_video": f"{_NEGATIVE} AND negative_scope = 'corpus' AND video_id IS NOT NULL",
}


def _rule(text: str, size: str, any_item: str, like: str) -> str:
    """A rule in one dialect: how it counts, searches and matches."""
    out = ""
    while "{" in text:
        head, rest = text.split("{", 1)
        inner, text = rest.split("}", 1)
        kind, _, arg = inner.partition(":")
        if kind == "n":
            part = size.format(x=arg)
        elif kind == "like":
            x, _, rx = arg.partition(":")
            part = like.format(x=x, rx=rx)
        else:
            x, _, cond = arg.partition(":")
            part = any_item.format(x=x, cond=cond)
        out += head + part
    return out + text


def spark_rule(text: str) -> str:
    """The rule as Spark SQL."""
    return _rule(text, "coalesce(array_size({x}), 0)", "coalesce(exists({x}, i -> {cond}), false)", "rlike({x}, '{rx}')")


def duck_rule(text: str) -> str:
    """The rule as the SQL of the tests."""
    return _rule(text, "coalesce(len({x}), 0)", "coalesce(len(list_filter({x}, lambda i: {cond})) > 0, false)", "regexp_matches({x}, '{rx}')")


@R.query("WITH r AS (SELECT id, unnest([" + ", ".join(f"CASE WHEN {duck_rule(c)} THEN '{n}' END" for n, c in RULES.items()) + "]) AS rule FROM dev_gold) SELECT rule, count(DISTINCT id) AS records FROM r WHERE rule IS NOT NULL GROUP BY rule")
def gold_schema_errors(spark, directory) -> DataFrame:
    """VAL-01, VAL-02, FLT-20: gold records that break each rule of their schema, conditional rules by type included."""
    rules = F.array_compact(F.array(*[F.expr(f"CASE WHEN {spark_rule(c)} THEN '{n}' END") for n, c in RULES.items()]))
    rows = table(spark, directory, "dev_gold").select("id", F.explode(rules).alias("rule"))
    return rows.groupBy("rule").agg(F.countDistinct("id").alias("records"))


_VISUAL = "[" + ", ".join(f"'{m}'" for m in VISUAL_MODALITIES) + "]"


@R.query(
    f"""WITH g AS (SELECT DISTINCT id, video_id, verified, modality, question_type, curation_source_version FROM dev_gold WHERE id IS NOT NULL),
v AS (SELECT curation_source_version AS newest FROM g WHERE curation_source_version IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
k AS (SELECT DISTINCT video_id FROM chunks WHERE video_id IS NOT NULL)
SELECT DISTINCT id, 'error' AS severity, 'unknown video' AS finding FROM g WHERE video_id IS NOT NULL AND video_id NOT IN (SELECT video_id FROM k)
UNION ALL SELECT DISTINCT id, 'error', 'not verified' FROM g WHERE NOT coalesce(verified, false)
UNION ALL SELECT DISTINCT id, 'error', 'no modality' FROM g WHERE modality IS NULL OR len(modality) = 0
UNION ALL SELECT DISTINCT id, 'warning', 'seen, not heard' FROM g WHERE len(list_intersect(modality, {_VISUAL})) > 0 AND NOT list_contains(modality, 'transcript')
UNION ALL SELECT DISTINCT id, 'warning', 'other curation version' FROM g, v WHERE curation_source_version <> newest"""
)
def corpus_findings(spark, directory) -> DataFrame:
    """VAL-03, JOIN-15: findings about gold records against the corpus, by severity."""
    g = table(spark, directory, "dev_gold").filter("id IS NOT NULL").select("id", "video_id", "verified", "modality", "question_type", "curation_source_version").distinct()
    known = table(spark, directory, "chunks").filter("video_id IS NOT NULL").select("video_id").distinct()
    # the version most records have: one row
    newest = g.filter("curation_source_version IS NOT NULL").groupBy(F.col("curation_source_version").alias("v")).agg(F.count("*").alias("n")).agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("newest"))
    visual = F.arrays_overlap("modality", F.array(*[F.lit(m) for m in VISUAL_MODALITIES]))
    parts = [
        (g.filter("video_id IS NOT NULL").join(known, "video_id", "left_anti"), "error", "unknown video"),
        (g.filter(~F.coalesce("verified", F.lit(False))), "error", "not verified"),
        (g.filter("modality IS NULL OR array_size(modality) = 0"), "error", "no modality"),
        (g.filter(visual & ~F.array_contains("modality", "transcript")), "warning", "seen, not heard"),
        (g.crossJoin(F.broadcast(newest)).filter("curation_source_version <> newest"), "warning", "other curation version"),
    ]
    out = None
    for rows, severity, finding in parts:
        one = rows.select("id", F.lit(severity).alias("severity"), F.lit(finding).alias("finding")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


@R.query(
    """WITH p AS (SELECT DISTINCT run_id, generator FROM per_example WHERE generator IS NOT NULL), r AS (SELECT DISTINCT run_id FROM p), g AS (SELECT DISTINCT generator FROM p)
SELECT r.run_id, g.generator FROM r CROSS JOIN g LEFT JOIN p ON p.run_id = r.run_id AND p.generator = g.generator WHERE p.run_id IS NULL"""
)
def unused_generators(spark, directory) -> DataFrame:
    """VAL-05, SET-08: generators that a run does not use."""
    p = table(spark, directory, "per_example").filter("generator IS NOT NULL").select("run_id", "generator").distinct()
    every = p.agg(F.collect_set("generator").alias("all"))
    used = p.groupBy("run_id").agg(F.collect_set("generator").alias("own"))
    return used.crossJoin(F.broadcast(every)).select("run_id", F.explode(F.array_except("all", "own")).alias("generator"))


@R.query(f"SELECT DISTINCT id, len(list_intersect(modality, {_VISUAL})) > 0 AS visual, CASE WHEN modality IS NULL OR len(modality) = 0 THEN 'no modality' WHEN len(list_intersect(modality, {_VISUAL})) = 0 THEN 'nothing to see' END AS error FROM dev_gold WHERE question_type = 'single_clip' AND id IS NOT NULL")
def visual_gold(spark, directory) -> DataFrame:
    """SRC-06, FLT-12: single-clip records with what is wrong about their modality, all collected."""
    g = table(spark, directory, "dev_gold").filter("question_type = 'single_clip' AND id IS NOT NULL")
    visual = F.arrays_overlap("modality", F.array(*[F.lit(m) for m in VISUAL_MODALITIES]))
    none = F.col("modality").isNull() | (F.array_size("modality") == 0)
    return g.select("id", visual.alias("visual"), F.when(none, "no modality").when(~visual, "nothing to see").alias("error")).distinct()


@R.query("SELECT DISTINCT id, question FROM dev_gold WHERE question_type = 'negative' AND negative_scope = 'corpus' AND id IS NOT NULL")
def corpus_negatives(spark, directory) -> DataFrame:
    """SRC-05, FLT-10: questions that no talk of the corpus answers."""
    return table(spark, directory, "dev_gold").filter("question_type = 'negative' AND negative_scope = 'corpus' AND id IS NOT NULL").select("id", "question").distinct()
