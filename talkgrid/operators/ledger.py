"""Append-only tables with a contract: inserts that refuse duplicates, traces, a queue of messages, applied migrations."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class DuplicateKey(ValueError):
    """A row with this key is there already."""


def read_or_none(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table in a folder, or None when nothing was written yet."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException:
        return None


def insert(spark: SparkSession, folder: str, rows: DataFrame, keys: list[str]) -> None:
    """Append rows whose keys are new; a key given twice or there already raises and nothing is written."""
    twice = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").limit(5).collect()
    kept = read_or_none(spark, folder)
    there = [] if kept is None else rows.select(*keys).join(kept.select(*keys), keys, "left_semi").limit(5).collect()
    if twice or there:
        raise DuplicateKey(f"{keys}: {[tuple(r)[: len(keys)] for r in [*twice, *there]]}")
    rows.write.mode("append").parquet(folder)


def trace_rows(traces: DataFrame, ends: DataFrame) -> DataFrame:
    """Started traces (trace, begun) with what their end says (trace, ended, status): running ones have no end; the last end counts."""
    last = ends.groupBy("trace").agg(F.max_by(F.struct("ended", "status"), "ended").alias("e"))
    return traces.join(last, "trace", "left").select("trace", "begun", F.col("e.ended").alias("ended"), F.coalesce("e.status", F.lit("running")).alias("status"))


def flush_spans(buffers: DataFrame, trace: str, columns: list[str]) -> DataFrame:
    """Spans buffered as parallel arrays, one row a span; arrays of unequal length are filled with nulls."""
    return buffers.select(F.col(trace), F.inline(F.arrays_zip(*columns)))


class Queue:
    """A queue of messages in a folder: sent, read under a visibility timeout, archived or deleted.

    Sends, reads and ends are appended as rows, so nothing is rewritten; what is visible follows from them.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _log(self, name: str, schema: str) -> DataFrame:
        found = read_or_none(self.spark, os.path.join(self.folder, name))
        return self.spark.createDataFrame([], schema) if found is None else found

    def send(self, messages: DataFrame, at: str) -> None:
        """Append messages (id, body)."""
        messages.select(F.col("id").cast("string"), F.col("body").cast("string"), F.lit(at).cast("timestamp").alias("at")).write.mode("append").parquet(os.path.join(self.folder, "sent"))

    def visible(self, at: str, timeout: float) -> DataFrame:
        """Messages not ended and not read within ``timeout`` seconds before ``at``: id, body, reads, oldest first."""
        sent = self._log("sent", "id string, body string, at timestamp")
        ended = self._log("ended", "id string, how string")
        reads = self._log("reads", "id string, at timestamp").groupBy("id").agg(F.max("at").alias("last"), F.count("*").alias("reads"))
        left = sent.join(ended.select("id"), "id", "left_anti").join(reads, "id", "left")
        now = F.unix_timestamp(F.lit(at).cast("timestamp"))
        return left.filter(F.col("last").isNull() | (F.unix_timestamp("last") + timeout <= now)).select("id", "body", F.coalesce("reads", F.lit(0)).alias("reads"), "at").orderBy("at", "id")

    def read(self, at: str, timeout: float, quantity: int) -> list:
        """Take at most ``quantity`` visible messages; they stay hidden for ``timeout`` seconds."""
        rows = self.visible(at, timeout).limit(quantity).collect()
        if rows:
            self.spark.createDataFrame([(r.id,) for r in rows], "id string").withColumn("at", F.lit(at).cast("timestamp")).write.mode("append").parquet(os.path.join(self.folder, "reads"))
        return rows

    def end(self, ids: list[str], how: str = "archived") -> None:
        """Archive or delete messages."""
        self.spark.createDataFrame([(i, how) for i in ids], "id string, how string").write.mode("append").parquet(os.path.join(self.folder, "ended"))

    def purge(self, at: str) -> int:
        """Delete all that is left, and say how many."""
        ids = [r.id for r in self.visible(at, 0).select("id").collect()]
        if ids:
            self.end(ids, "deleted")
        return len(ids)


def migrate(spark: SparkSession, folder: str, found: dict[str, object]) -> list[str]:
    """Apply the migrations (name -> callable(spark)) not applied yet, in the order of their names.

    Each is recorded when it has ended; the first that fails is raised again, and those before it stay applied.
    """
    log = read_or_none(spark, folder)
    done = set() if log is None else {r.name for r in log.select("name").distinct().collect()}
    applied = []
    for name in sorted(set(found) - done):
        found[name](spark)
        spark.createDataFrame([(name,)], "name string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(folder)
        applied.append(name)
    return applied


def backoff(attempt: Column, base: float = 1.0, jitter: Column | float = 0.0) -> Column:
    """Seconds to wait before an attempt: ``base * 2^attempt`` and what ``jitter`` adds."""
    return F.lit(base) * F.pow(F.lit(2.0), attempt) + jitter


def run_id(prefix: str) -> Column:
    """``prefix`` and twelve random hexadecimal digits."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12))
