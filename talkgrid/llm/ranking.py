"""One ranking from several differently-scaled scores (problem 5): outranking net flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkgrid.session import checkpointed

#: Items of one list that are ranked in one task; longer lists are cut into ordered shards.
SHARD_ROWS = 100_000
#: Percentiles are whole parts of a million, so all sums are exact.
WHOLE = 1_000_000
#: Percentiles this close are equal to the preference function; from the other distance on it is full; it is linear between.
INDIFFERENT, PREFERRED = 50_000, 500_000
_FRACTIONS = [i / 256 for i in range(1, 256)]


def _clean(scores: DataFrame) -> DataFrame:
    """One row (g, c, i, score, rank) per item of a list; rows with neither score nor rank drop out."""
    one = scores.filter("g IS NOT NULL AND c IS NOT NULL AND i IS NOT NULL")
    finite = F.when(~F.isnan("score") & (F.abs("score") < 1.7e308), F.col("score"))
    one = one.select("g", "c", "i", finite.alias("score"), F.when(F.col("rank") > 0, F.col("rank").cast("bigint")).alias("rank"))
    return one.groupBy("g", "c", "i").agg(F.max("score").alias("score"), F.min("rank").alias("rank")).filter("score IS NOT NULL OR rank IS NOT NULL")


def _percentile(place: Column, places: Column) -> Column:
    """The percentile of a place among the places, rounded to parts of a million."""
    return F.floor((2 * WHOLE * (places - place + 1) + places) / (2 * places)).cast("bigint")


def preference(distance: Column, q: int, p: int) -> Column:
    """How much a percentile that lies ``distance`` higher is preferred, in parts of ``p - q``."""
    return F.greatest(F.lit(0), F.least(F.lit(p - q), distance - q)).cast("bigint")


def _flows(rows: DataFrame, order, n: Column, count: Column, whole, q: int, p: int) -> DataFrame:
    """Adds the positive and negative flow against the items of the list, from running counts and sums of ``x``."""
    upto = lambda off: order.rangeBetween(W.unboundedPreceding, off)
    for name, off in (("1", -p), ("2", -q), ("3", q), ("4", p)):
        rows = rows.withColumn(f"c{name}", F.coalesce(F.sum(count).over(upto(off)), F.lit(0))).withColumn(f"s{name}", F.coalesce(F.sum(count * F.col("x")).over(upto(off)), F.lit(0)))
    up = F.col("c1") * (p - q) + (F.col("c2") - F.col("c1")) * (F.col("x") - q) - (F.col("s2") - F.col("s1"))
    down = (n - F.col("c4")) * (p - q) + (F.col("s4") - F.col("s3")) - (F.col("c4") - F.col("c3")) * (F.col("x") + q)
    pref = preference(F.col("x"), q, p)
    return rows.select("*", up.alias("up"), down.alias("down"), pref.alias("pref"), F.sum(count * pref).over(whole).alias("sp"), F.row_number().over(order).alias("k")).drop(*[f"{a}{b}" for a in "cs" for b in "1234"])


def _short(one: DataFrame, q: int, p: int) -> DataFrame:
    """Lists of one task each: places, percentiles and flows over one shuffle by list."""
    whole = W.partitionBy("g", "c")
    scored = whole.orderBy(F.col("score").desc_nulls_last()).rangeBetween(W.unboundedPreceding, W.currentRow)
    placed = one.withColumn("o", F.when(F.col("score").isNull(), F.col("rank")).otherwise(F.count("score").over(scored)))
    placed = placed.withColumn("n", F.count("*").over(whole)).withColumn("x", _percentile(F.col("o"), F.greatest("n", F.max("o").over(whole))))
    return _flows(placed.select("g", "c", "i", "n", "x"), whole.orderBy("x"), F.col("n"), F.lit(1), whole, q, p).select("g", "c", "i", "n", "up", "down", "pref", "sp", (F.col("k") == 1).alias("first"))


def _long(one: DataFrame, q: int, p: int) -> DataFrame:
    """The same for lists of any length: places over ordered shards, flows over counts per percentile.

    A list has at most ``WHOLE`` percentiles, so the window per list holds a bounded number of rows.
    """
    cuts = one.groupBy("g", "c").agg(F.percentile_approx(-F.col("score"), _FRACTIONS, 2000).alias("cuts"))
    shard = F.when(F.col("cuts").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda v: v < -F.col("score"))))
    a = one.join(cuts, ["g", "c"]).withColumn("b", shard).drop("cuts")
    scored = W.partitionBy("g", "c", "b").orderBy(F.col("score").desc_nulls_last()).rangeBetween(W.unboundedPreceding, W.currentRow)
    a = a.withColumn("o", F.count("score").over(scored))
    ends = a.groupBy("g", "c", "b").agg(F.count("score").alias("sn"))
    before = F.coalesce(F.sum("sn").over(W.partitionBy("g", "c").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    a = a.join(ends.select("g", "c", "b", before.alias("before")), ["g", "c", "b"])
    a = a.select("g", "c", "i", F.when(F.col("score").isNull(), F.col("rank")).otherwise(F.col("o") + F.col("before")).alias("o"))
    size = a.groupBy("g", "c").agg(F.count("*").alias("n"), F.max("o").alias("mo"))
    placed = a.join(size, ["g", "c"]).select("g", "c", "i", "n", _percentile(F.col("o"), F.greatest("n", "mo")).alias("x"))
    counts = placed.groupBy("g", "c", "x", "n").agg(F.count("*").alias("cnt"))
    whole = W.partitionBy("g", "c")
    flows = _flows(counts, whole.orderBy("x"), F.col("n"), F.col("cnt"), whole, q, p).drop("n", "cnt")
    # the list's sum enters once, with one item of its first percentile
    least = placed.groupBy("g", "c").agg(F.min(F.struct("x", "i")).alias("l")).select("g", "c", F.col("l.i").alias("li"))
    rows = placed.join(flows, ["g", "c", "x"]).join(least, ["g", "c"])
    return rows.select("g", "c", "i", "n", "up", "down", "pref", "sp", (F.col("i") == F.col("li")).alias("first"))


def net_flow(
    scores: DataFrame, group: str, criterion: str, item: str, score: str, rank: str, weights: dict[str, float] | None = None, indifferent: int = INDIFFERENT, preferred: int = PREFERRED, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """Outranking flows of every item of a group over all of its lists.

    A list is the rows of one criterion in one group; higher scores are better.  An item's percentile
    in a list of ``m`` places is ``(m - place + 1) / m`` in whole parts of a million, whatever the range
    and spread of the score.  On each list item a is preferred to b by a function of the distance of
    their percentiles: nothing up to ``indifferent``, all from ``preferred`` on, linear between.  An
    item absent from a list has percentile 0 there and gets nothing from it.  With the list sorted by percentile, the
    items below and above at each distance come from running counts and sums, so all pairs count and none is
    formed; sums are whole numbers and exact.  Flows are weighted (``weights`` by criterion, 1 each by
    default), divided by the number of other items and summed over the lists.

    Output: group, item, positive, negative, net, lists.

    Places: the number of scores at least as good; where the score is missing, the recorded rank.
    Repeated rows of an item in a list count once.  NaN and infinite scores count as missing; rows
    without score and rank, or with a null group, criterion or item, take no part; empty tables give no rows.

    Scale: duplicates collapse in a hash aggregate.  A list of up to ``shard_rows`` items is sorted in one
    task; longer ones are cut into ordered shards by quantiles of their score, and their flows are taken
    from counts per percentile, so a list with a third of all rows is never held by one task.  One job counts
    the rows of the lists when this is called; that branch is planned only if one is long, and gives the same flows.
    """
    if not 0 <= indifferent < preferred <= WHOLE:
        raise ValueError("need 0 <= indifferent < preferred <= 1000000")
    q, p = indifferent, preferred
    raw = scores.select(F.col(f"`{group}`").alias("g"), F.col(f"`{criterion}`").alias("c"), F.col(f"`{item}`").alias("i"), F.col(f"`{score}`").cast("double").alias("score"), F.col(f"`{rank}`").alias("rank"))
    one = _clean(raw)
    most = raw.groupBy("g", "c").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= shard_rows:
        rows = _short(one, q, p)
    else:
        long = one.groupBy("g", "c").agg(F.count("*").alias("n")).filter(F.col("n") > shard_rows).select("g", "c")
        rows = _short(one.join(long, ["g", "c"], "left_anti"), q, p).unionByName(_long(checkpointed(one.join(long, ["g", "c"], "left_semi")), q, p))
    weight = F.lit(1)
    if weights is not None:
        weight = F.coalesce(F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])[F.col("c")], F.lit(0.0))
    rows = rows.withColumn("w", weight)
    per_item = rows.groupBy("g", "i").agg(
        F.sum(F.col("w") * F.col("up")).alias("up"),
        F.sum(F.col("w") * F.col("down")).alias("down"),
        F.sum(F.col("w") * F.col("pref")).alias("wp"),
        F.sum(F.col("w") * F.col("pref") * F.col("n")).alias("wpn"),
        F.sum(F.col("w") * F.col("sp")).alias("own_sp"),
        F.sum(F.when(F.col("first"), F.col("w") * F.col("sp")).otherwise(0)).alias("sp"),
        F.count("*").alias("lists"),
    )
    per_group = per_item.groupBy("g").agg(F.count("*").alias("items"), F.sum("sp").alias("all_sp"))
    both = per_item.join(per_group, "g")
    others = F.greatest(F.col("items") - 1, F.lit(1)) * F.lit(float(p - q))
    # against items absent from a list its preference counts whole; where an item is absent itself, it loses the list's sum
    up = F.col("up") + F.col("wp") * F.col("items") - F.col("wpn")
    down = F.col("down") + F.col("all_sp") - F.col("own_sp")
    return both.select(F.col("g").alias(group), F.col("i").alias(item), (up / others).alias("positive"), (down / others).alias("negative"), ((up - down) / others).alias("net"), "lists")


def top_items(flows: DataFrame, group: str, item: str, k: int) -> DataFrame:
    """The ``k`` items of each group with the largest net flow (then the smallest item), and their place.

    ``row_number`` with a bound becomes a group limit before the shuffle, so only ``k`` rows of a group
    per task are moved.
    """
    place = F.row_number().over(W.partitionBy(group).orderBy(F.round("net", 9).desc(), F.col(item)))
    return flows.withColumn("place", place).filter(F.col("place") <= k)
