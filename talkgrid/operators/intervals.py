"""Interval algebra per entity: coalescing, gaps, overlap measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARD_MS = 3_600_000


def to_ms(seconds: Column) -> Column:
    """Seconds (double) to whole milliseconds, rounded half away from zero."""
    return F.round(seconds * 1000).cast("bigint")


def valid_span(start: Column, end: Column) -> Column:
    """Both bounds present and finite, and the end after the start."""
    top = F.lit(9.0e15)
    return start.isNotNull() & end.isNotNull() & ~F.isnan(start) & ~F.isnan(end) & (F.abs(start) < top) & (F.abs(end) < top) & (end > start)


def _islands(df: DataFrame, keys: list[str]) -> DataFrame:
    """Merge overlapping or touching ``[s, e]`` within ``keys`` (one window per key)."""
    w = W.partitionBy(*keys).orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0))
    marked = marked.withColumn("__isl", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return marked.groupBy(*keys, "__isl").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("__isl")


def _merged(rows: DataFrame, w: int) -> DataFrame:
    """Islands ``(entity, s, e)`` of the rows, merged in shards of width ``w`` and stitched per entity."""
    first, last = F.floor(F.col("s") / w), F.floor((F.col("e") - 1) / w)
    head = F.struct(first.alias("k"), F.col("s"), F.least(F.col("e"), (first + 1) * w).alias("e"))
    tail = F.when(last > first, F.struct(last.alias("k"), (last * w).alias("s"), F.col("e")))
    pieces = rows.select("entity", F.explode(F.array_compact(F.array(head, tail))).alias("p")).groupBy("entity", "p.k", "p.s").agg(F.max("p.e").alias("e"))
    # the whole shards between head and tail of a long interval stay one row
    across = rows.filter(last > first + 1).select("entity", ((first + 1) * w).alias("s"), (last * w).alias("e")).groupBy("entity", "s").agg(F.max("e").alias("e"))
    local = _islands(pieces, ["entity", "k"])
    touch = (F.col("s") == F.col("k") * w) | (F.col("e") == (F.col("k") + 1) * w)
    stitched = _islands(local.filter(touch).select("entity", "s", "e").unionByName(across), ["entity"]).select("entity", "s", "e")
    # islands inside a shard that a long interval covers whole are part of it; one row a shard is looked at
    inner = local.filter(~touch)
    named = lambda df: df.select(F.col("entity").alias("__ent")).distinct()
    shards = inner.select("entity", (F.col("k") * w).alias("s")).distinct().join(named(across), F.col("entity").eqNullSafe(F.col("__ent")), "left_semi")
    marks = shards.withColumn("e", F.lit(None).cast("bigint")).unionByName(across)
    reach = F.max("e").over(W.partitionBy("entity").orderBy("s", F.col("e").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow))
    covered = marks.withColumn("reach", reach).filter(F.col("e").isNull() & (F.col("reach") > F.col("s"))).select(F.col("entity").alias("__ent"), F.floor(F.col("s") / w).alias("__k"))
    left = inner.join(covered, F.col("entity").eqNullSafe(F.col("__ent")) & (F.col("k") == F.col("__k")), "left_anti")
    return left.select("entity", "s", "e").unionByName(stitched)


def coalesce_intervals(df: DataFrame, entity: str, start_ms: str, end_ms: str, shard_ms: int = SHARD_MS) -> DataFrame:
    """Continuous periods ``(entity, s, e)`` of each entity, by a two-level merge.

    1. Every interval gives the piece in its first and the piece in its last time shard, and one row for
       the whole shards between; pieces are reduced to one row per (entity, shard, start) before anything
       is sorted.  The width of a shard is fixed: no interval, however long, changes how the others
       are spread, and an entity with a third of all rows lies in as many tasks as it has shards.
    2. Each shard is merged on its own.  Only islands that touch a shard boundary and the rows between go
       on to be stitched per entity: at most three an occupied shard, so a task's share follows from the
       stretch of time an entity covers (26,000 rows a year of whole hours), not from its number of rows.

    Rows with a null bound or ``end <= start`` take no part; a null entity is an entity of its
    own; touching intervals continue a period; an empty table gives no rows.  Extra columns are
    ignored.
    """
    ok = df.select(F.col(f"`{entity}`").alias("entity"), F.col(f"`{start_ms}`").cast("bigint").alias("s"), F.col(f"`{end_ms}`").cast("bigint").alias("e")).filter("e > s")
    return _merged(ok, shard_ms)


def with_next(periods: DataFrame, shard_ms: int = SHARD_MS) -> DataFrame:
    """Periods ``(entity, s, e)`` of :func:`coalesce_intervals` with the start ``nxt`` of the following one.

    It comes from a window per (entity, shard); the last period of a shard looks at a per-shard
    summary, so the window per entity holds one row per shard only.
    """
    p = periods.withColumn("k", F.floor(F.col("s") / shard_ms))
    p = p.withColumn("nxt", F.lead("s").over(W.partitionBy("entity", "k").orderBy("s")))
    heads = p.groupBy("entity", "k").agg(F.min("s").alias("first_s"))
    heads = heads.withColumn("nxt_head", F.lead("first_s").over(W.partitionBy("entity").orderBy("k"))).select(F.col("entity").alias("__ent"), F.col("k").alias("__k"), "nxt_head")
    joined = p.join(heads, F.col("entity").eqNullSafe(F.col("__ent")) & (F.col("k") == F.col("__k")))
    return joined.select("entity", "s", "e", F.coalesce("nxt", "nxt_head").alias("nxt"))


def _is_gap(max_gap_ms: int | None) -> Column:
    hole = F.coalesce(F.col("nxt") > F.col("e"), F.lit(False))
    return hole if max_gap_ms is None else hole & (F.col("nxt") - F.col("e") <= max_gap_ms)


def interval_gaps(periods: DataFrame, max_gap_ms: int | None = None, shard_ms: int = SHARD_MS) -> DataFrame:
    """Holes ``(entity, s, e)`` between consecutive periods; those longer than ``max_gap_ms`` are breaks and left out."""
    return with_next(periods, shard_ms).filter(_is_gap(max_gap_ms)).select("entity", F.col("e").alias("s"), F.col("nxt").alias("e"))


def periods_and_gaps(periods: DataFrame, max_gap_ms: int | None = None, shard_ms: int = SHARD_MS) -> DataFrame:
    """Both in one pass: kind (``period``, ``gap``), entity, s, e."""
    own = F.struct(F.lit("period").alias("kind"), F.col("s"), F.col("e"))
    hole = F.when(_is_gap(max_gap_ms), F.struct(F.lit("gap").alias("kind"), F.col("e").alias("s"), F.col("nxt").alias("e")))
    rows = with_next(periods, shard_ms).select("entity", F.explode(F.array_compact(F.array(own, hole))).alias("r"))
    return rows.select("r.kind", "entity", "r.s", "r.e")


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length of the common part of two intervals, 0 when disjoint."""
    return F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over union of two intervals; 0 when the union is empty."""
    common = overlap(s1, e1, s2, e2)
    union = (e1 - s1) + (e2 - s2) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def bin_range_join(points: DataFrame, spans: DataFrame, key: str, point: str, start: str, end: str, width: float = 60.0, pieces: int = 64) -> DataFrame:
    """Points joined to the half-open spans ``[start, end)`` of the same ``key`` that hold them.

    An equi-join on (key, time bin) with the exact test on top, so neither a huge key nor a long
    span meets every other row: spans are laid into all bins they touch.  Spans touching more than
    ``pieces`` bins go to a coarser second grid of bins ``pieces`` times as wide, and so on; each
    level is one more branch of the union, five levels cover 64^5 minutes.
    Null keys, points or bounds and spans with ``end <= start`` match nothing.
    """
    pts = points.filter(F.col(key).isNotNull() & F.col(point).isNotNull())
    sp = spans.filter(F.col(key).isNotNull() & valid_span(F.col(start), F.col(end)))
    length = F.floor(F.col(end) / width) - F.floor(F.col(start) / width)
    sp = sp.withColumn("__lvl", F.when(length < pieces, 0).when(length < pieces**2, 1).when(length < pieces**3, 2).when(length < pieces**4, 3).otherwise(4))
    sp = sp.withColumn("__w", F.lit(width) * F.pow(F.lit(float(pieces)), F.col("__lvl")))
    sp = sp.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / F.col("__w")).cast("bigint"), F.floor(F.col(end) / F.col("__w")).cast("bigint"))))
    grids = F.array(*[F.struct(F.lit(i).alias("l"), F.floor(F.col(point) / (width * float(pieces) ** i)).cast("bigint").alias("b")) for i in range(5)])
    pts = pts.withColumn("__g", F.explode(grids)).select("*", F.col("__g.l").alias("__pl"), F.col("__g.b").alias("__pb"), F.col(key).alias("__pk")).drop("__g", key)
    hit = (F.col("__pk") == F.col(key)) & (F.col("__pl") == F.col("__lvl")) & (F.col("__pb") == F.col("__bin")) & (F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))
    return pts.join(sp, hit).drop("__pk", "__pl", "__pb", "__lvl", "__w", "__bin")
