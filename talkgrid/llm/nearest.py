"""Matching records by nearest time within an entity (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_in_time(left: DataFrame, right: DataFrame, left_id: str, left_key: str, left_time: str, right_id: str, right_key: str, right_time: str, tolerance: float) -> DataFrame:
    """Each left record with the right record of the same entity nearest in time.

    Right records are laid into buckets as wide as the tolerance; a left record looks into its own
    and the two adjacent buckets, the difference is tested exactly, and the least
    ``(difference, right time, right id)`` is kept by a hash aggregate (``min`` of a struct).

    Both sides are first reduced to one row per (entity, time): right records to their smallest id,
    left records to a distinct time, and the left ids are joined back at the end.  A bucket therefore
    never pairs repeated times with each other, and an entity with a third of all rows is spread over
    its buckets.

    Output: left_id, right_id, diff.  Left records without a time, entity or partner within the
    tolerance do not appear; a difference of exactly the tolerance counts; null, NaN and infinite
    times take no part; equal distances go to the earlier right time, equal times to the smaller
    id; repeated rows count once; empty tables give no rows.  Other columns are ignored.
    """
    def clean(df, i, k, t):
        c = df.select(F.col(f"`{i}`").alias("id"), F.col(f"`{k}`").alias("k"), F.col(f"`{t}`").cast("double").alias("t"))
        return c.filter(F.col("id").isNotNull() & F.col("k").isNotNull() & F.col("t").isNotNull() & ~F.isnan("t") & (F.abs("t") < 9e15))

    tol = float(tolerance)
    # adding zero turns -0.0 into 0.0, so equal times are equal keys
    lhs = clean(left, left_id, left_key, left_time).withColumn("t", F.col("t") + 0.0)
    rhs = clean(right, right_id, right_key, right_time).groupBy("k", "t").agg(F.min("id").alias("rid"))
    rhs = rhs.select("k", F.col("t").alias("rt"), "rid", F.floor(F.col("t") / tol).alias("b"))
    times = lhs.select("k", "t").distinct().withColumn("b0", F.floor(F.col("t") / tol))
    probes = times.withColumn("b", F.explode(F.array(F.col("b0") - 1, F.col("b0"), F.col("b0") + 1))).drop("b0")
    hits = probes.join(rhs, ["k", "b"]).withColumn("d", F.abs(F.col("t") - F.col("rt"))).filter(F.col("d") <= tol)
    best = hits.groupBy("k", "t").agg(F.min(F.struct("d", "rt", "rid")).alias("m"))
    out = lhs.distinct().join(best, ["k", "t"])
    return out.select(F.col("id").alias("left_id"), F.col("m.rid").alias("right_id"), F.col("m.d").alias("diff")).distinct()
