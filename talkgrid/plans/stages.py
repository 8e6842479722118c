"""Queries over chains of stages, strategies and time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.operators import fusion, stages
from talkgrid.plans.metrics import _GOLD_SQL, _gold, _hits, _results
from talkgrid.plans.registry import Registry
from talkgrid.tables import table

R = Registry()
WIDTHS = [5, 10, 30]
TOLERANCE_SEC = 10.0

_RANKS_SQL = (
    f"WITH {_GOLD_SQL},"
    + """ one AS (SELECT query_id, channel, chunk_id, min(rank) AS rank, max(CASE WHEN ovl THEN 1 ELSE 0 END) AS hit FROM h GROUP BY ALL),
wide AS (SELECT *, unnest([5, 10, 30]) AS width FROM one),
per AS (SELECT query_id, width, chunk_id, sum(CASE WHEN rank <= width THEN 1.0 / (60 + rank) END) AS score, min(CASE WHEN rank <= width AND hit = 1 THEN rank END) AS listed, max(hit) AS hit FROM wide GROUP BY ALL),
fz AS (SELECT *, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY query_id, width ORDER BY round(score, 9) DESC NULLS LAST, chunk_id) END AS fr FROM per),
rb AS (SELECT query_id, chunk_id, max(rerank_score) AS rs FROM reranked_results WHERE rerank_score IS NOT NULL GROUP BY ALL),
kp AS (SELECT fz.*, coalesce(fr <= 30, false) AS kept, rs FROM fz LEFT JOIN rb USING (query_id, chunk_id)),
rr AS (SELECT *, CASE WHEN kept AND rs IS NOT NULL THEN row_number() OVER (PARTITION BY query_id, width ORDER BY CASE WHEN kept THEN rs END DESC NULLS LAST, chunk_id) END AS rr FROM kp),
ranks AS (SELECT query_id, width, min(listed) AS listed, count(*) FILTER (hit = 1 AND kept) AS survivors, min(CASE WHEN hit = 1 THEN fr END) AS fused_rank, min(CASE WHEN hit = 1 THEN rr END) AS reranked_rank FROM rr GROUP BY ALL)
"""
)


def _ranks(spark, directory) -> DataFrame:
    return stages.stage_ranks(_results(spark, directory), table(spark, directory, "reranked_results"), _gold(spark, directory), WIDTHS)


@R.query(_RANKS_SQL + "SELECT query_id, CAST(width AS INT) AS width, listed, survivors, fused_rank, reranked_rank FROM ranks")
def stage_replay(spark, directory) -> DataFrame:
    """CMP-10, AGG-35, WIN-04: rank of the gold after every stage, for three prefilter widths."""
    return _ranks(spark, directory)


@R.query(
    _RANKS_SQL
    + """SELECT CAST(width AS INT) AS width, CASE WHEN listed IS NULL THEN 'stage_1_miss' WHEN survivors = 0 THEN 'stage_2_miss' WHEN reranked_rank IS NULL OR reranked_rank > 5 THEN 'stage_3_miss' ELSE 'passed_at_5' END AS stage, count(*) AS queries FROM ranks GROUP BY ALL"""
)
def loss_stages(spark, directory) -> DataFrame:
    """CLS-01: queries by the first stage that loses their gold."""
    return _ranks(spark, directory).groupBy("width", stages.loss_stage().alias("stage")).agg(F.count("*").alias("queries"))


@R.query(
    _RANKS_SQL
    + """, m AS (SELECT query_id, CASE WHEN bool_or(coalesce(reranked_rank <= 5, false)) THEN 'passes' WHEN bool_and(listed IS NULL) THEN 'blind' WHEN bool_or(survivors > 0) THEN 'demoted' ELSE 'other' END AS mode FROM ranks GROUP BY query_id)
SELECT mode, count(*) AS queries FROM m GROUP BY mode"""
)
def failure_modes(spark, directory) -> DataFrame:
    """CLS-02: queries by their failure over the sweep of widths."""
    return stages.failure_modes(_ranks(spark, directory)).groupBy("mode").agg(F.count("*").alias("queries"))


@R.query(
    """WITH s AS (SELECT DISTINCT frame_id, video_id, frame_sec FROM frame_samples WHERE frame_sec IS NOT NULL),
f AS (SELECT DISTINCT query_id, frame_id, video_id, frame_sec, rank FROM frame_results WHERE rank IS NOT NULL AND frame_sec IS NOT NULL),
q AS (SELECT f.*, s.video_id AS q_video, s.frame_sec AS q_sec FROM f JOIN s ON f.query_id = 'fq-' || s.frame_id WHERE f.frame_id <> s.frame_id)
SELECT query_id, bool_or(coalesce(video_id = q_video AND frame_sec BETWEEN q_sec - 10 AND q_sec + 10, false) AND rank <= 5) AS near_at_5, count(*) FILTER (coalesce(video_id = q_video AND frame_sec BETWEEN q_sec - 10 AND q_sec + 10, false)) AS near_frames FROM q GROUP BY query_id"""
)
def frame_window_recall(spark, directory) -> DataFrame:
    """FLT-08, CMP-01: whether a frame search returns a frame at most 10 s (closed) from the asking one among its five first."""
    s = table(spark, directory, "frame_samples").filter("frame_sec IS NOT NULL").select(F.concat(F.lit("fq-"), F.col("frame_id").cast("string")).alias("query_id"), F.col("frame_id").alias("q_frame"), F.col("video_id").alias("q_video"), F.col("frame_sec").alias("q_sec")).distinct()
    f = table(spark, directory, "frame_results").filter("rank IS NOT NULL AND frame_sec IS NOT NULL").select("query_id", "frame_id", "video_id", "frame_sec", "rank").distinct()
    near = F.coalesce((F.col("video_id") == F.col("q_video")) & F.col("frame_sec").between(F.col("q_sec") - TOLERANCE_SEC, F.col("q_sec") + TOLERANCE_SEC), F.lit(False))
    rows = f.join(s, "query_id").filter("frame_id <> q_frame")
    return rows.groupBy("query_id").agg(F.bool_or(near & (F.col("rank") <= 5)).alias("near_at_5"), F.count(F.when(near, 1)).alias("near_frames"))


@R.query(
    f"WITH {_GOLD_SQL},"
    + """ st AS (SELECT chunk_id, min(chunking_strategy) AS strategy FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
x AS (SELECT h.*, strategy FROM h JOIN st USING (chunk_id)),
p AS (SELECT strategy, channel, query_id, max(CASE WHEN ovl AND rank <= 5 THEN 1.0 ELSE 0.0 END) AS tr, max(CASE WHEN contains AND rank <= 5 THEN 1.0 ELSE 0.0 END) AS held, max(CASE WHEN rank = 1 THEN iou ELSE 0.0 END) AS iou1 FROM x GROUP BY ALL),
a AS (SELECT count(DISTINCT query_id) AS asked FROM h),
c AS (SELECT strategy, count(*) AS chunks, round(avg(d), 1) AS mean_sec FROM (SELECT DISTINCT chunk_id, chunking_strategy AS strategy, round(end_sec - start_sec, 6) AS d FROM chunks WHERE end_sec > start_sec AND isfinite(start_sec) AND isfinite(end_sec)) GROUP BY strategy)
SELECT strategy, channel, asked AS queries, round(sum(tr) / asked, 6) AS recall, round(sum(held) / asked, 6) AS contained, round(sum(iou1) / asked, 6) AS iou_at_1, chunks, mean_sec FROM p, a JOIN c USING (strategy) GROUP BY strategy, channel, asked, chunks, mean_sec""".replace("FROM p, a JOIN c USING (strategy)", "FROM p JOIN c USING (strategy), a")
)
def strategy_metrics(spark, directory) -> DataFrame:
    """CMP-02: the metrics of every strategy and channel over all asked queries, with the strategy's chunks."""
    hits = _hits(spark, directory)
    kinds = table(spark, directory, "chunks").filter("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.min("chunking_strategy").alias("strategy"))
    with_chunk = _results(spark, directory).join(kinds, "chunk_id").select("query_id", F.concat_ws("\u0001", "strategy", "channel").alias("channel"), "chunk_id", "video_id", "start_sec", "end_sec", "rank")
    measured = fusion.recall_at(fusion.interval_hits(with_chunk, _gold(spark, directory)), 5, hits.select("query_id").distinct())
    span = table(spark, directory, "chunks").filter("end_sec > start_sec AND abs(start_sec) < 1e300 AND abs(end_sec) < 1e300").select("chunk_id", F.col("chunking_strategy").alias("strategy"), F.round(F.col("end_sec") - F.col("start_sec"), 6).alias("d")).distinct()
    chunks = span.groupBy("strategy").agg(F.count("*").alias("chunks"), F.round(F.avg("d"), 1).alias("mean_sec"))
    parts = F.split("channel", "\u0001")
    return measured.withColumn("strategy", parts[0]).withColumn("channel", parts[1]).join(chunks, "strategy").select("strategy", "channel", "queries", "recall", "contained", "iou_at_1", "chunks", "mean_sec")


@R.query(
    f"WITH {_GOLD_SQL},"
    + """ a AS (SELECT count(DISTINCT query_id) AS asked FROM h), p AS (SELECT channel, query_id, max(CASE WHEN ovl AND rank <= 5 THEN 1.0 ELSE 0.0 END) AS tr FROM h GROUP BY ALL),
c AS (SELECT channel, sum(tr) / asked AS recall FROM p, a GROUP BY channel, asked)
SELECT round(max(CASE WHEN channel IN ('dense', 'sparse', 'multivec') THEN recall END), 6) AS vector_best, round(max(recall), 6) AS best FROM c"""
)
def vector_best(spark, directory) -> DataFrame:
    """AGG-12, CMP-03, CMP-13: the best recall among the vector channels and among all."""
    hits = _hits(spark, directory)
    c = fusion.recall_at(hits, 5)
    return c.agg(F.max(F.when(F.col("channel").isin("dense", "sparse", "multivec"), F.col("recall"))).alias("vector_best"), F.max("recall").alias("best"))
