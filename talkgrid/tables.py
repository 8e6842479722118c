"""Reading the Parquet tables and counting re-delivered rows once."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its source files are at most this large, read from file sizes.
BROADCAST_BYTES = 32 * 1024 * 1024


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` in ``directory`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` in bytes, from file sizes; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its estimated size is at most ``limit``, else unchanged.

    Beyond the limit the join falls back to a shuffled join, so nothing that grows is ever
    forced onto every executor.
    """
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def once(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """One row per key: the first in ``order`` (default: the least row by all columns).

    Uses a hash aggregate with map-side combine (``min_by``), not a window, so a key with a
    third of all rows is reduced before the shuffle.  Null keys form their own group.  Only
    orderable columns may be compared; maps are left out of the default order.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    if order is None:
        order = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name in rest and "map<" not in f.dataType.simpleString()]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), rank)
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(row.alias("__row")).select(*[F.col(f"`{k}`") for k in keys], *[F.col("__row")[c].alias(c) for c in rest])


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers of ``spark`` find this package where the driver found it.

    On a cluster the package is installed or sent along (``spark.submit.pyFiles``); this only helps
    workers that share the driver's disk.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
