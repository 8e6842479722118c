"""Mutations of Parquet tables as plans: keep-latest upserts, replaced children, shallow JSON merges."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: Column, tie: list[Column] | None = None) -> DataFrame:
    """The last row of every key in ``order``; a hash aggregate with map-side combine, no window."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(order.alias("__o"), *[t.alias(f"__t{i}") for i, t in enumerate(tie or [])])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__r")).select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def upsert(target: DataFrame, source: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """Target rows, replaced by source rows of the same key, plus new ones.

    Columns in ``keep`` are never taken from the source while the target has a value.  Keys must be
    unique and not null on both sides.
    """
    if not keep:
        return target.join(source, keys, "left_anti").unionByName(source.select(*target.columns))
    t, s = target.alias("t"), source.alias("s")
    both = t.join(s, [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys], "full_outer")
    seen = F.col(f"s.{keys[0]}").isNotNull()
    cols = [F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")).alias(c) if c in keys or c in keep else F.when(seen, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns]
    return both.select(*cols)


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of the parents named in ``new`` are dropped and its rows put in their place."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new.select(*children.columns))


def delete_cascade(children: DataFrame, parents_left: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents_left.select(key).distinct(), key, "left_semi")


def json_patch(doc: Column, patch: Column) -> Column:
    """Shallow merge of two JSON objects, the patch's keys win; values stay as written, keys sorted."""
    kind = "map<string,string>"
    a, b = F.from_json(doc, kind), F.from_json(patch, kind)
    a, b = F.coalesce(a, F.create_map().cast(kind)), F.coalesce(b, F.create_map().cast(kind))
    mine = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(mine, b))))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def commit_tables(spark: SparkSession, tables: dict[str, DataFrame], folder: str, version: int) -> str:
    """Write several tables as one version: data first, the manifest that readers follow last.

    Readers take the newest manifest, so they see all tables of a version or none of them.
    """
    base = f"{folder}/v{version}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")
    body = json.dumps({"version": version, "tables": sorted(tables)})
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest-{version:09d}")
    return base


def newest_version(spark: SparkSession, folder: str) -> dict:
    """The manifest of the newest committed version."""
    rows = spark.read.text(os.path.join(folder, "manifest-*")).select(F.max_by("value", F.get_json_object("value", "$.version").cast("bigint")).alias("v")).collect()
    return json.loads(rows[0].v)
