"""Equi-joins with hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key in one task.
ROWS_PER_TASK = 20_000


def salted_join(probes: DataFrame, rows: DataFrame, keys: list[str], spread: str, per: int = ROWS_PER_TASK) -> DataFrame:
    """Inner join of ``probes`` with the larger ``rows`` on ``keys``.

    Rows are counted per key (with map-side combine); a key with more than ``per`` of them is cut into
    salts in proportion to its count, by a hash of ``spread``, and its probes are repeated once a salt.  So a
    key that holds a third of all rows lies in many tasks, and no row is lost.  Null keys match nothing.
    Column names other than the keys must differ.
    """
    count = rows.groupBy(*keys).agg(F.ceil(F.count("*") / per).cast("int").alias("__salts"))
    left = probes.join(count, keys).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
    hot = count.filter("`__salts` > 1")
    right = rows.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), F.coalesce("__salts", F.lit(1)).cast("bigint")).cast("int")).drop("__salts")
    return left.join(right, [*keys, "__salt"]).drop("__salt")
