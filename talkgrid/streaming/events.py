"""Structured Streaming forms of the batch operators: windowed counts, keep-latest and claimed steps."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from talkgrid.operators import merge


def read_files(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 8, form: str = "parquet") -> DataFrame:
    """A folder of files as a stream; a replay after a failure starts from the checkpointed offsets."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(folder)


def windowed_counts(events: DataFrame, ts: str, key: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their sum per window and key; state of windows older than the watermark is dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count("*").alias("events"), F.sum(value).alias("total"))


def once_each(events: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """Events without re-deliveries inside the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def keep_latest_sink(spark: SparkSession, folder: str, keys: list[str], order: str, parts: int = 64) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that merges each batch into a table by key, exactly once.

    The table lies in ``parts`` partitions by a hash of the key, each with versions of its own.  A batch writes
    version ``batch_id + 1`` of the partitions its keys fall into, merged from their newest earlier version, so its cost
    follows the batch; a repeated batch rewrites the same versions from the same input.  The manifest that
    names the newest version of every partition is written last, so readers never see half of one.
    """
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")

    def sink(batch: DataFrame, batch_id: int) -> None:
        before = part_versions(spark, folder, batch_id)
        own = batch.withColumn("__part", part).persist()
        try:
            touched = sorted(r[0] for r in own.select("__part").distinct().collect())
            if not touched:
                return
            old = [f"{folder}/data/version={before[p]}/__part={p}" for p in touched if p in before]
            rows = own
            if old:
                rows = own.unionByName(spark.read.parquet(*old).withColumn("__part", part))
            merged = merge.latest(rows.drop("__part"), keys, F.col(order)).withColumn("__part", part)
            merged.repartition("__part").write.mode("overwrite").partitionBy("__part").parquet(f"{folder}/data/version={batch_id + 1}")
            body = json.dumps({"version": batch_id + 1, "parts": {str(p): v for p, v in (before | {p: batch_id + 1 for p in touched}).items()}})
            spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest-{batch_id + 1:09d}")
        finally:
            own.unpersist()

    return sink


def part_versions(spark: SparkSession, folder: str, upto: int | None = None) -> dict[int, int]:
    """The newest committed version of every partition, of the manifests up to a version."""
    try:
        rows = spark.read.text(os.path.join(folder, "manifest-*"))
    except AnalysisException:
        return {}
    number = F.get_json_object("value", "$.version").cast("bigint")
    if upto is not None:
        rows = rows.filter(number <= upto)
    newest = rows.select(F.max_by("value", number).alias("v")).first().v
    return {int(p): v for p, v in json.loads(newest)["parts"].items()} if newest else {}


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run the stream until all input is taken, then stop."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The table at its newest committed version."""
    return spark.read.parquet(*[f"{folder}/data/version={v}/__part={p}" for p, v in sorted(part_versions(spark, folder).items())])


def fan_out(parents: DataFrame, parent: str, children: str, kind: str) -> DataFrame:
    """One pending row per child of every parent: parent, step, entity."""
    return parents.select(parent, F.lit(kind).alias("step"), F.explode(children).alias("entity"), F.lit("pending").alias("status"))
