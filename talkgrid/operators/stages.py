"""Where in a chain of retrieval stages the marked interval is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlaps_gold() -> Column:
    """Open overlap of a chunk with the marked interval of its query, on the same video."""
    return F.coalesce((F.col("video_id") == F.col("g_video")) & (F.col("end_sec") > F.col("g_start")) & (F.col("start_sec") < F.col("g_end")), F.lit(False))


def stage_ranks(results: DataFrame, reranked: DataFrame, gold: DataFrame, widths: list[int], fused: int = 30) -> DataFrame:
    """Per query and prefilter width: the gold's rank after each stage, null where it is gone.

    Stage 1 keeps the ``width`` first of every channel, stage 2 the ``fused`` first by reciprocal ranks,
    stage 3 is the reranker.  Output: query_id, width, listed (best channel rank), survivors (overlapping fused
    chunks), fused_rank, reranked_rank.  Every gold query that some channel was asked is there.
    """
    one = results.groupBy("query_id", "channel", "chunk_id").agg(F.min("rank").alias("rank"), F.min(F.struct("video_id", "start_sec", "end_sec")).alias("m"))
    asked = one.join(gold, "query_id").select("query_id", "channel", "chunk_id", "rank", "m.*", "g_video", "g_start", "g_end").withColumn("hit", overlaps_gold())
    wide = asked.select("*", F.explode(F.array(*[F.lit(w) for w in widths])).alias("width"))
    inside = F.col("rank") <= F.col("width")
    per = wide.groupBy("query_id", "width", "chunk_id").agg(F.sum(F.when(inside, 1.0 / (60 + F.col("rank")))).alias("score"), F.min(F.when(inside & F.col("hit"), F.col("rank"))).alias("listed"), F.max("hit").alias("hit"))
    order = F.row_number().over(W.partitionBy("query_id", "width").orderBy(F.round("score", 9).desc_nulls_last(), "chunk_id"))
    fusedr = per.withColumn("fr", F.when(F.col("score").isNotNull(), order)).withColumn("kept", F.coalesce(F.col("fr") <= fused, F.lit(False)))
    best = reranked.filter("rerank_score IS NOT NULL").groupBy("query_id", "chunk_id").agg(F.max("rerank_score").alias("rs"))
    last = fusedr.join(best, ["query_id", "chunk_id"], "left")
    again = F.row_number().over(W.partitionBy("query_id", "width").orderBy(F.when(F.col("kept"), F.col("rs")).desc_nulls_last(), "chunk_id"))
    last = last.withColumn("rr", F.when(F.col("kept") & F.col("rs").isNotNull(), again))
    return last.groupBy("query_id", "width").agg(
        F.min("listed").alias("listed"), F.count(F.when(F.col("hit") & F.col("kept"), 1)).alias("survivors"), F.min(F.when(F.col("hit"), F.col("fr"))).alias("fused_rank"), F.min(F.when(F.col("hit"), F.col("rr"))).alias("reranked_rank")
    )


def loss_stage(top: int = 5) -> Column:
    """The first stage at which the gold is lost."""
    return F.when(F.col("listed").isNull(), "stage_1_miss").when(F.col("survivors") == 0, "stage_2_miss").when(F.col("reranked_rank").isNull() | (F.col("reranked_rank") > top), "stage_3_miss").otherwise(f"passed_at_{top}")


def failure_modes(ranks: DataFrame, top: int = 5) -> DataFrame:
    """Per query over all widths: passes at one, blind at all, demoted everywhere, or other."""
    per = ranks.groupBy("query_id").agg(F.bool_or(F.coalesce(F.col("reranked_rank") <= top, F.lit(False))).alias("ok"), F.bool_and(F.col("listed").isNull()).alias("blind"), F.bool_or(F.col("survivors") > 0).alias("seen"))
    return per.select("query_id", F.when(F.col("ok"), "passes").when(F.col("blind"), "blind").when(F.col("seen"), "demoted").otherwise("other").alias("mode"))
