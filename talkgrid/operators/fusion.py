"""Fusing ranked lists, reranking, and metrics of ranked lists against marked intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkgrid.operators.intervals import iou
from talkgrid.operators.vectors import top_k

RRF_K = 60


def reciprocal_rank_fusion(lists: DataFrame, group: str, item: str, channel: str, rank: str, k: int = RRF_K, top: int = 8) -> DataFrame:
    """Sum over channels of ``1 / (k + rank)``, with the ranks it came from.

    Rows without a rank give nothing; a channel that holds an item twice counts its best rank.
    """
    one = lists.filter(F.col(rank).isNotNull() & F.col(item).isNotNull()).groupBy(group, item, channel).agg(F.min(rank).alias("r"))
    fused = one.groupBy(group, item).agg(F.round(F.sum(1.0 / (k + F.col("r"))), 9).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(channel, "r")))).alias("channel_ranks"))
    return top_k(fused, [group], "score", item, top)


def sigmoid(x: Column) -> Column:
    """``1 / (1 + exp(-x))``."""
    return 1.0 / (1.0 + F.exp(-x))


def interval_hits(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Results of the gold record's video with their overlap of its interval.

    ``results``: query_id, channel, video_id, start_sec, end_sec, rank; ``gold``: query_id, g_video,
    g_start, g_end.  Open overlap: touching intervals do not overlap.
    """
    j = results.join(gold, "query_id")
    same = F.col("video_id") == F.col("g_video")
    return j.select(
        "query_id", "channel", "rank", "start_sec", "end_sec", "g_start", "g_end",
        F.coalesce(same, F.lit(False)).alias("same_video"),
        F.coalesce(same & (F.col("end_sec") > F.col("g_start")) & (F.col("start_sec") < F.col("g_end")), F.lit(False)).alias("overlaps"),
        F.coalesce(same & (F.col("start_sec") <= F.col("g_start")) & (F.col("end_sec") >= F.col("g_end")), F.lit(False)).alias("contains"),
        F.when(same, iou(F.col("start_sec"), F.col("end_sec"), F.col("g_start"), F.col("g_end"))).otherwise(F.lit(0.0)).alias("iou"),
    )


def recall_at(hits: DataFrame, k: int, asked: DataFrame | None = None) -> DataFrame:
    """Per channel: share of queries with an overlap, with a containment in the top ``k``; mean IoU at 1.

    The denominator is all ``asked`` queries (query_id; by default those with a hit in any channel), so a query for which
    a channel returned nothing counts as a miss.
    """
    per = hits.groupBy("channel", "query_id").agg(
        F.max(F.when(F.col("overlaps") & (F.col("rank") <= k), 1.0).otherwise(0.0)).alias("tr"),
        F.max(F.when(F.col("contains") & (F.col("rank") <= k), 1.0).otherwise(0.0)).alias("held"),
        F.max(F.when(F.col("rank") == 1, F.col("iou")).otherwise(0.0)).alias("iou1"),
    )
    total = (hits.select("query_id") if asked is None else asked.select("query_id")).agg(F.countDistinct("query_id").alias("queries"))
    sums = per.groupBy("channel").agg(F.sum("tr").alias("tr"), F.sum("held").alias("held"), F.sum("iou1").alias("iou1")).crossJoin(F.broadcast(total))
    return sums.select("channel", "queries", F.round(F.col("tr") / F.col("queries"), 6).alias("recall"), F.round(F.col("held") / F.col("queries"), 6).alias("contained"), F.round(F.col("iou1") / F.col("queries"), 6).alias("iou_at_1"))


def agreement_kappa(pairs: DataFrame, a: str, b: str, labels: list[int], weight: str = "none") -> DataFrame:
    """Cohen's kappa of two raters over ordinal labels; pairs with a null are left out, no variation gives 0."""
    if weight not in ("none", "linear", "quadratic"):
        raise ValueError(f"unknown weights {weight!r}")
    span = max(1, len(labels) - 1)
    counts = pairs.filter(F.col(a).isin(labels) & F.col(b).isin(labels)).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    rows = counts.groupBy("a").agg(F.sum("n").alias("ra"))
    cols = counts.groupBy("b").agg(F.sum("n").alias("cb"))
    total = counts.agg(F.sum("n").alias("t"))
    apart = F.abs(F.col("a") - F.col("b")) / F.lit(float(span))
    cost = {"none": F.when(F.col("a") == F.col("b"), 0.0).otherwise(1.0), "linear": apart, "quadratic": apart * apart}[weight]
    # label grids are at most len(labels) squared rows
    expected = F.broadcast(rows).crossJoin(F.broadcast(cols)).crossJoin(F.broadcast(total)).agg(F.sum(cost * F.col("ra") * F.col("cb") / F.col("t")).alias("e"), F.max("t").alias("n"))
    observed = counts.agg(F.sum(cost * F.col("n")).alias("o"))
    both = expected.crossJoin(observed)
    return both.select(F.lit(weight).alias("weights"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.round(F.when(F.col("e") == 0, 0.0).otherwise(1 - F.col("o") / F.col("e")), 6).alias("kappa"))


def kappa_set(counts: DataFrame, labels: tuple[int, ...] = (1, 2, 3, 4, 5), least: int = 4) -> DataFrame:
    """Linear and quadratic kappa of counted pairs (x, y, n) and that of both at ``least``, rounded to 3 digits; no pairs give null."""
    flags = counts.select((F.col("x") >= least).cast("int").alias("x"), (F.col("y") >= least).cast("int").alias("y"), "n")
    parts = [(counts, len(labels) - 1, "linear"), (counts, len(labels) - 1, "quadratic"), (flags, 1, "binarized")]
    out = None
    for rows, span, name in parts:
        apart = F.abs(F.col("x") - F.col("y")) / F.lit(float(span))
        cost = apart * apart if name == "quadratic" else apart
        by_x, by_y, total = rows.groupBy("x").agg(F.sum("n").alias("nx")), rows.groupBy("y").agg(F.sum("n").alias("ny")), rows.agg(F.sum("n").alias("t"))
        # at most one row a label on either side
        grid = by_x.crossJoin(F.broadcast(by_y)).crossJoin(F.broadcast(total)).agg(F.sum(cost * F.col("nx") * F.col("ny") / F.col("t")).alias("e"), F.max("t").alias("t"))
        seen = rows.agg(F.sum(cost * F.col("n")).alias("o"))
        one = grid.crossJoin(seen).select(F.lit(name).alias("weights"), F.coalesce("t", F.lit(0)).cast("bigint").alias("n"), F.round(F.when(F.col("e") == 0, 0.0).otherwise(1 - F.col("o") / F.col("e")), 3).alias("kappa"))
        out = one if out is None else out.unionByName(one)
    return out
