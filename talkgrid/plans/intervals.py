"""Queries over the time intervals of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.operators.intervals import coalesce_intervals, periods_and_gaps, to_ms, valid_span
from talkgrid.plans.registry import Registry
from talkgrid.tables import table

R = Registry()

#: Holes longer than this are breaks between sessions.
MAX_GAP_MS = 900_000

_PERIODS_SQL = """
WITH c AS (
  SELECT video_id, CAST(round(start_sec * 1000) AS BIGINT) AS s, CAST(round(end_sec * 1000) AS BIGINT) AS e
  FROM chunks WHERE start_sec IS NOT NULL AND end_sec > start_sec AND isfinite(start_sec) AND isfinite(end_sec)),
m AS (SELECT *, max(e) OVER (PARTITION BY video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM c WHERE e > s),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
p AS (SELECT video_id, min(s) AS s, max(e) AS e FROM i GROUP BY video_id, k)
"""


def _periods(spark, directory) -> DataFrame:
    chunks = table(spark, directory, "chunks").filter(valid_span(F.col("start_sec"), F.col("end_sec")))
    spans = chunks.select("video_id", to_ms(F.col("start_sec")).alias("s0"), to_ms(F.col("end_sec")).alias("e0"))
    return coalesce_intervals(spans, "video_id", "s0", "e0")


@R.query(
    _PERIODS_SQL
    + """, g AS (SELECT video_id, e AS s, lead(s) OVER (PARTITION BY video_id ORDER BY s) AS e FROM p)
SELECT 'period' AS kind, video_id, s AS start_ms, e AS end_ms FROM p
UNION ALL SELECT 'gap', video_id, s, e FROM g WHERE e IS NOT NULL AND e - s <= 900000"""
)
def p2_found(spark, directory) -> DataFrame:
    """Continuous periods of each video over all strategies, and the holes of at most 900 s."""
    rows = periods_and_gaps(_periods(spark, directory), MAX_GAP_MS)
    return rows.select("kind", F.col("entity").alias("video_id"), F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))


@R.query(
    _PERIODS_SQL
    + """, g AS (SELECT video_id, e AS s, lead(s) OVER (PARTITION BY video_id ORDER BY s) AS e FROM p),
h AS (SELECT video_id, count(*) AS gaps, CAST(sum(e - s) AS BIGINT) AS gap_ms FROM g WHERE e - s <= 900000 GROUP BY video_id),
q AS (SELECT video_id, count(*) AS periods, CAST(sum(e - s) AS BIGINT) AS covered_ms FROM p GROUP BY video_id)
SELECT q.video_id, periods, covered_ms, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(gap_ms, 0) AS gap_ms
FROM q LEFT JOIN h ON q.video_id IS NOT DISTINCT FROM h.video_id"""
)
def p2_coverage(spark, directory) -> DataFrame:
    """Per video: number and length of its periods and of its gaps."""
    rows = periods_and_gaps(_periods(spark, directory), MAX_GAP_MS)
    long = F.col("e") - F.col("s")
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    return rows.groupBy(F.col("entity").alias("video_id")).agg(
        F.count(of("period", 1)).alias("periods"), F.sum(of("period", long)).alias("covered_ms"), F.count(of("gap", 1)).alias("gaps"), F.coalesce(F.sum(of("gap", long)), F.lit(0)).alias("gap_ms")
    )
