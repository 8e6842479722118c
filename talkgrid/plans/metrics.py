"""Queries that measure ranked lists, answers and raters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkgrid.operators import fusion
from talkgrid.operators.intervals import coalesce_intervals, to_ms, valid_span
from talkgrid.plans.registry import Registry
from talkgrid.tables import once, table

R = Registry()
K = 5

_GOLD_SQL = """
g AS (SELECT id AS query_id, any_value(coalesce(gold_spans[1].video_id, video_id)) AS g_video, any_value(gold_spans[1].start_sec) AS g_start, any_value(gold_spans[1].end_sec) AS g_end
      FROM dev_gold WHERE len(gold_spans) > 0 AND gold_spans[1].end_sec > gold_spans[1].start_sec GROUP BY id),
r AS (SELECT DISTINCT query_id, channel, chunk_id, video_id, start_sec, end_sec, rank FROM channel_results WHERE rank IS NOT NULL AND end_sec > start_sec),
h AS (SELECT query_id, channel, chunk_id, rank, start_sec, end_sec, g_start, g_end, coalesce(video_id = g_video, false) AS same,
        coalesce(video_id = g_video AND end_sec > g_start AND start_sec < g_end, false) AS ovl, coalesce(video_id = g_video AND start_sec <= g_start AND end_sec >= g_end, false) AS contains,
        CASE WHEN video_id = g_video THEN greatest(0, least(end_sec, g_end) - greatest(start_sec, g_start)) / ((end_sec - start_sec) + (g_end - g_start) - greatest(0, least(end_sec, g_end) - greatest(start_sec, g_start))) ELSE 0 END AS iou
      FROM r JOIN g USING (query_id))
"""


def _gold(spark, directory) -> DataFrame:
    first = F.get(F.col("gold_spans"), 0)
    rows = table(spark, directory, "dev_gold").select(F.col("id").alias("query_id"), F.coalesce(first["video_id"], F.col("video_id")).alias("g_video"), first["start_sec"].alias("g_start"), first["end_sec"].alias("g_end"))
    return once(rows.filter(F.col("g_end") > F.col("g_start")), ["query_id"])


def _results(spark, directory) -> DataFrame:
    rows = table(spark, directory, "channel_results").filter("rank IS NOT NULL AND end_sec > start_sec")
    return rows.select("query_id", "channel", "chunk_id", "video_id", "start_sec", "end_sec", "rank").distinct()


def _hits(spark, directory) -> DataFrame:
    return fusion.interval_hits(_results(spark, directory), _gold(spark, directory))


def _first_ranks(spark, directory) -> DataFrame:
    """Rank ``r`` of the first overlap for every asked query and channel, null where a channel has none."""
    hits = _hits(spark, directory)
    found = hits.filter("overlaps").groupBy("query_id", "channel").agg(F.min("rank").alias("r"))
    # the few channels are one row of arrays
    channels = hits.agg(F.collect_set("channel").alias("cs"))
    asked = hits.select("query_id").distinct().crossJoin(F.broadcast(channels)).select("query_id", F.explode("cs").alias("channel"))
    return asked.join(found, ["query_id", "channel"], "left")


@R.query(
    f"WITH {_GOLD_SQL}"
    + """, p AS (SELECT channel, query_id, max(CASE WHEN ovl AND rank <= 5 THEN 1.0 ELSE 0.0 END) AS tr, max(CASE WHEN contains AND rank <= 5 THEN 1.0 ELSE 0.0 END) AS held, max(CASE WHEN rank = 1 THEN iou ELSE 0.0 END) AS iou1 FROM h GROUP BY ALL)
SELECT channel, asked AS queries, round(sum(tr) / asked, 6) AS recall, round(sum(held) / asked, 6) AS contained, round(sum(iou1) / asked, 6) AS iou_at_1 FROM p, (SELECT count(DISTINCT query_id) AS asked FROM h) GROUP BY channel, asked"""
)
def channel_recall(spark, directory) -> DataFrame:
    """JOIN-10, AGG-06..09, AGG-12, FLT-07, FLT-09, MTH-01: recall, containment and IoU of each channel."""
    return fusion.recall_at(_hits(spark, directory), K)


@R.query(
    f"WITH {_GOLD_SQL}"
    + """, q AS (SELECT c.channel, a.query_id, min(CASE WHEN ovl THEN rank END) AS first_rank FROM (SELECT DISTINCT channel FROM h) c CROSS JOIN (SELECT DISTINCT query_id FROM h) a LEFT JOIN h USING (channel, query_id) GROUP BY ALL)
SELECT channel, CASE WHEN first_rank IS NULL THEN 'absent' WHEN first_rank <= 5 THEN '1-5' WHEN first_rank <= 20 THEN '6-20' WHEN first_rank <= 50 THEN '21-50' ELSE '>50' END AS bucket, count(*) AS queries FROM q GROUP BY ALL"""
)
def first_gold_rank(spark, directory) -> DataFrame:
    """WIN-04, CLS-03, AGG-24: bucket of the first overlapping rank."""
    r = F.col("r")
    bucket = F.when(r.isNull(), "absent").when(r <= 5, "1-5").when(r <= 20, "6-20").when(r <= 50, "21-50").otherwise(">50")
    return _first_ranks(spark, directory).groupBy("channel", bucket.alias("bucket")).agg(F.count("*").alias("queries"))


@R.query(
    f"WITH {_GOLD_SQL}"
    + """, q AS (SELECT c.channel, a.query_id, min(CASE WHEN ovl THEN rank END) AS f FROM (SELECT DISTINCT channel FROM h) c CROSS JOIN (SELECT DISTINCT query_id FROM h) a LEFT JOIN h USING (channel, query_id) GROUP BY ALL)
SELECT channel, k AS top, round(avg(CASE WHEN f <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM q, (VALUES (5), (10), (20), (200)) t(k) GROUP BY ALL"""
)
def recall_curve(spark, directory) -> DataFrame:
    """CMP-14, AGG-35, TOPK-04: recall of each channel at 5, 10, 20 and 200."""
    q = _first_ranks(spark, directory).select("channel", F.col("r").alias("f"), F.explode(F.array(*[F.lit(k) for k in (5, 10, 20, 200)])).alias("top"))
    return q.groupBy("channel", "top").agg(F.round(F.avg(F.when(F.col("f") <= F.col("top"), 1.0).otherwise(0.0)), 6).alias("recall"))


@R.query(
    f"WITH {_GOLD_SQL}"
    + """, s AS (SELECT channel, query_id, CAST(round(start_sec * 1000) AS BIGINT) AS s, CAST(round(end_sec * 1000) AS BIGINT) AS e, CAST(round(g_start * 1000) AS BIGINT) AS gs, CAST(round(g_end * 1000) AS BIGINT) AS ge FROM h WHERE same AND rank <= 5),
m AS (SELECT *, max(e) OVER (PARTITION BY channel, query_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM s),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY channel, query_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
p AS (SELECT channel, query_id, k, min(s) AS s, max(e) AS e, min(gs) AS gs, min(ge) AS ge FROM i GROUP BY ALL),
u AS (SELECT channel, query_id, sum(e - s) AS len, sum(greatest(0, least(e, ge) - greatest(s, gs))) AS common, min(ge - gs) AS g FROM p GROUP BY ALL),
a AS (SELECT count(DISTINCT query_id) AS asked FROM h), ch AS (SELECT DISTINCT channel FROM h)
SELECT ch.channel, round(coalesce(sum(common / (len + g - common)), 0) / asked, 6) AS region_iou FROM ch LEFT JOIN u USING (channel), a GROUP BY ch.channel, asked"""
)
def region_iou(spark, directory) -> DataFrame:
    """AGG-10, AGG-11, WIN-07: IoU of the union of the five first chunks with the gold interval."""
    hits = _hits(spark, directory)
    near = hits.filter(F.col("same_video") & (F.col("rank") <= K)).select("channel", "query_id", to_ms(F.col("start_sec")).alias("s"), to_ms(F.col("end_sec")).alias("e"), to_ms(F.col("g_start")).alias("gs"), to_ms(F.col("g_end")).alias("ge"))
    keyed = near.withColumn("key", F.to_json(F.struct("channel", "query_id")))
    gold = keyed.select("key", "channel", "query_id", "gs", "ge").distinct()
    parts = coalesce_intervals(keyed, "key", "s", "e").join(gold, F.col("entity") == F.col("key"))
    common = F.greatest(F.lit(0), F.least("e", "ge") - F.greatest("s", "gs"))
    u = parts.groupBy("channel", "query_id").agg(F.sum(F.col("e") - F.col("s")).alias("len"), F.sum(common).alias("common"), F.min(F.col("ge") - F.col("gs")).alias("g"))
    sums = u.groupBy("channel").agg(F.sum(F.col("common") / (F.col("len") + F.col("g") - F.col("common"))).alias("s"))
    per = hits.select("channel").distinct().join(sums, "channel", "left").crossJoin(F.broadcast(hits.agg(F.countDistinct("query_id").alias("asked"))))
    return per.select("channel", F.round(F.coalesce("s", F.lit(0.0)) / F.col("asked"), 6).alias("region_iou"))


@R.query(
    f"WITH {_GOLD_SQL}"
    + """, f AS (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS a, sum(CASE WHEN channel <> 'visual' THEN 1.0 / (60 + rank) END) AS b FROM (SELECT query_id, channel, chunk_id, min(rank) AS rank FROM r GROUP BY ALL) GROUP BY ALL),
k AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(a, 9) DESC, chunk_id) AS ra, CASE WHEN b IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY round(b, 9) DESC NULLS LAST, chunk_id) END AS rb FROM f),
o AS (SELECT query_id, chunk_id, max(CASE WHEN ovl THEN 1 ELSE 0 END) AS hit FROM h GROUP BY ALL),
q AS (SELECT query_id, max(CASE WHEN ra <= 5 THEN hit ELSE 0 END) AS wa, max(CASE WHEN rb <= 5 THEN hit ELSE 0 END) AS wb FROM k JOIN o USING (query_id, chunk_id) GROUP BY query_id)
SELECT count(*) AS queries, round(avg(wa), 6) AS with_channel, round(avg(wb), 6) AS without_channel, round_even((avg(wa) - avg(wb)) * 100, 2) AS lift_pp FROM q"""
)
def visual_lift(spark, directory) -> DataFrame:
    """AGG-21: percentage points by which the visual channel lifts the fused recall at 5."""
    r = _results(spark, directory).groupBy("query_id", "channel", "chunk_id").agg(F.min("rank").alias("rank"))
    part = 1.0 / (60 + F.col("rank"))
    f = r.groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 9).alias("a"), F.round(F.sum(F.when(F.col("channel") != "visual", part)), 9).alias("b"))
    rank = lambda c: F.row_number().over(W.partitionBy("query_id").orderBy(F.col(c).desc_nulls_last(), "chunk_id"))
    k = f.withColumn("ra", rank("a")).withColumn("rb", F.when(F.col("b").isNotNull(), rank("b")))
    hits = _results(spark, directory).join(_gold(spark, directory), "query_id").groupBy("query_id", "chunk_id").agg(
        F.max(F.coalesce((F.col("video_id") == F.col("g_video")) & (F.col("end_sec") > F.col("g_start")) & (F.col("start_sec") < F.col("g_end")), F.lit(False)).cast("int")).alias("hit")
    )
    q = k.join(hits, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.max(F.when(F.col("ra") <= K, F.col("hit")).otherwise(0)).alias("wa"), F.max(F.when(F.col("rb") <= K, F.col("hit")).otherwise(0)).alias("wb"))
    return q.agg(F.count("*").alias("queries"), F.round(F.avg("wa"), 6).alias("with_channel"), F.round(F.avg("wb"), 6).alias("without_channel"), F.bround((F.avg("wa") - F.avg("wb")) * 100, 2).alias("lift_pp"))


@R.query(
    """WITH c AS (SELECT DISTINCT chunk_id, video_id, chunking_strategy, round(end_sec - start_sec, 6) AS d FROM chunks WHERE end_sec > start_sec AND isfinite(start_sec) AND isfinite(end_sec)),
l AS (SELECT video_id, chunking_strategy, count(*) AS chunks, avg(d) AS mean, list(d ORDER BY d) AS v FROM c GROUP BY ALL)
SELECT video_id, chunking_strategy, chunks, round(mean, 1) AS mean_sec, v[CAST(greatest(1, least(chunks, round_even(chunks * 0.95 + 0.5, 0))) AS INT)] AS p95_sec FROM l"""
)
def chunk_stats(spark, directory) -> DataFrame:
    """AGG-13, AGG-14, MTH-05: number, mean and 95th percentile of chunk lengths by video and strategy.

    The percentile needs a rank, not the whole group: rows are counted per length first.
    """
    c = table(spark, directory, "chunks").filter(valid_span(F.col("start_sec"), F.col("end_sec"))).select("chunk_id", "video_id", "chunking_strategy", F.round(F.col("end_sec") - F.col("start_sec"), 6).alias("d")).distinct()
    counts = c.groupBy("video_id", "chunking_strategy", "d").agg(F.count("*").alias("n"))
    w = W.partitionBy("video_id", "chunking_strategy")
    ranked = counts.withColumn("upto", F.sum("n").over(w.orderBy("d"))).withColumn("chunks", F.sum("n").over(w))
    want = F.greatest(F.lit(1), F.least(F.col("chunks"), F.bround(F.col("chunks") * 0.95 + 0.5).cast("bigint")))
    per = ranked.groupBy("video_id", "chunking_strategy").agg(F.max("chunks").alias("chunks"), (F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("mean"), F.min(F.when(F.col("upto") >= want, F.col("d"))).alias("p95_sec"))
    return per.select("video_id", "chunking_strategy", "chunks", F.round("mean", 1).alias("mean_sec"), "p95_sec")


@R.query(
    """WITH p AS (SELECT DISTINCT run_id, generator, example_id, latency_ms FROM per_example WHERE latency_ms IS NOT NULL),
l AS (SELECT generator, count(*) AS answers, list(latency_ms ORDER BY latency_ms) AS v FROM p GROUP BY generator)
SELECT generator, answers, CAST(v[CAST(greatest(1, least(answers, round_even(answers * 0.95 + 0.5, 0))) AS INT)] AS DOUBLE) AS p95_ms FROM l"""
)
def latency_p95(spark, directory) -> DataFrame:
    """AGG-13, WIN-11: 95th percentile of latency by generator, from counts per latency."""
    p = table(spark, directory, "per_example").filter("latency_ms IS NOT NULL").select("run_id", "generator", "example_id", "latency_ms").distinct()
    counts = p.groupBy("generator", "latency_ms").agg(F.count("*").alias("n"))
    w = W.partitionBy("generator")
    ranked = counts.withColumn("upto", F.sum("n").over(w.orderBy("latency_ms"))).withColumn("answers", F.sum("n").over(w))
    want = F.greatest(F.lit(1), F.least(F.col("answers"), F.bround(F.col("answers") * 0.95 + 0.5).cast("bigint")))
    return ranked.groupBy("generator").agg(F.max("answers").alias("answers"), F.min(F.when(F.col("upto") >= want, F.col("latency_ms"))).cast("double").alias("p95_ms"))


_ANSWERS_SQL = """
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, example_id ORDER BY generator, set_name, answer, abstain, parse_ok, raw_response, error, metrics, latency_ms, completed_at) AS n FROM per_example) WHERE n = 1),
t AS (SELECT id, any_value(question_type) AS question_type FROM dev_gold GROUP BY id)
"""


def _answers(spark, directory) -> DataFrame:
    p = once(table(spark, directory, "per_example"), ["run_id", "example_id"])
    types = once(table(spark, directory, "dev_gold").select(F.col("id").alias("example_id"), "question_type"), ["example_id"])
    return p.join(types, "example_id", "left")


@R.query(
    f"WITH {_ANSWERS_SQL}"
    + """SELECT generator, count(*) AS answers, count(m) AS judged, round(avg(m), 6) AS grounded, round(coalesce(avg(CASE WHEN parse_ok THEN 1.0 WHEN NOT parse_ok THEN 0.0 END), 0), 6) AS parsed,
  round(avg(CASE WHEN question_type = 'negative' AND abstain THEN 1.0 WHEN question_type = 'negative' AND NOT abstain THEN 0.0 END), 6) AS refused_negatives
FROM (SELECT p.*, question_type, TRY_CAST(json_extract_string(metrics, '$.claims_grounded_frac') AS DOUBLE) AS m FROM p LEFT JOIN t ON t.id = p.example_id) GROUP BY generator"""
)
def answer_rates(spark, directory) -> DataFrame:
    """AGG-18, AGG-19, AGG-20, JOIN-19, JSN-08, FLT-15: rates over the answers that can be judged."""
    a = _answers(spark, directory).withColumn("m", F.expr("try_cast(get_json_object(metrics, '$.claims_grounded_frac') AS double)"))
    negative = F.col("question_type") == "negative"
    return a.groupBy("generator").agg(
        F.count("*").alias("answers"), F.count("m").alias("judged"), F.round(F.avg("m"), 6).alias("grounded"), F.round(F.coalesce(F.avg(F.col("parse_ok").cast("double")), F.lit(0.0)), 6).alias("parsed"),
        F.round(F.avg(F.when(negative, F.col("abstain").cast("double"))), 6).alias("refused_negatives"),
    )


@R.query(
    f"WITH {_ANSWERS_SQL}, j AS (SELECT p.*, CASE WHEN NOT regexp_matches(raw_response, ',\\s*[}}\\]]') THEN try_cast(raw_response AS JSON) END AS d FROM p WHERE raw_response IS NOT NULL)"
    + """SELECT run_id, example_id, d IS NOT NULL AS is_json, json_extract_string(d, '$.answer') AS answer, CAST(json_array_length(d, '$.claims') AS INT) AS claims, json_type(d, '$.abstain') = 'BOOLEAN' AS abstain_is_boolean FROM j"""
)
def generation_parse(spark, directory) -> DataFrame:
    """JSN-01: model output read strictly, a field counts only with its declared JSON type."""
    a = once(table(spark, directory, "per_example"), ["run_id", "example_id"]).filter("raw_response IS NOT NULL")
    v = F.try_parse_json("raw_response")
    a = a.select("run_id", "example_id", "raw_response", v.alias("v"))
    is_json = F.col("v").isNotNull()
    kind = F.schema_of_variant(F.try_variant_get("v", "$.abstain", "variant"))
    return a.select(
        "run_id", "example_id", is_json.alias("is_json"), F.when(is_json, F.get_json_object("raw_response", "$.answer")).alias("answer"),
        F.when(is_json, F.json_array_length(F.get_json_object("raw_response", "$.claims"))).alias("claims"), F.when(is_json, kind == "BOOLEAN").alias("abstain_is_boolean"),
    )


@R.query(
    f"WITH {_ANSWERS_SQL}, a AS (SELECT id, bool_or(abstention_expected) AS expected FROM dev_gold GROUP BY id),"
    + """ z AS (SELECT CAST(expected AS INT) AS x, CAST(abstain AS INT) AS y FROM p JOIN a ON a.id = p.example_id WHERE expected IS NOT NULL AND abstain IS NOT NULL),
c AS (SELECT x, y, count(*) AS n FROM z GROUP BY ALL), rx AS (SELECT x, sum(n) AS n FROM c GROUP BY x), cy AS (SELECT y, sum(n) AS n FROM c GROUP BY y), s AS (SELECT sum(n) AS t FROM c),
e AS (SELECT sum(CASE WHEN x <> y THEN rx.n * cy.n / t ELSE 0 END) AS e FROM rx, cy, s), o AS (SELECT sum(CASE WHEN x <> y THEN n ELSE 0 END) AS o FROM c)
SELECT 'none' AS weights, CAST(t AS BIGINT) AS n, round(CASE WHEN e = 0 THEN 0 ELSE 1 - o / e END, 6) AS kappa FROM e, o, s"""
)
def abstain_kappa(spark, directory) -> DataFrame:
    """AGG-22, JOIN-14: agreement of abstentions with the expected ones."""
    gold = table(spark, directory, "dev_gold").groupBy(F.col("id").alias("example_id")).agg(F.max("abstention_expected").cast("int").alias("x"))
    pairs = once(table(spark, directory, "per_example"), ["run_id", "example_id"]).select("example_id", F.col("abstain").cast("int").alias("y")).join(gold, "example_id")
    return fusion.agreement_kappa(pairs, "x", "y", [0, 1], "none")


@R.query(
    """WITH g AS (SELECT id, any_value(expected_claims) AS claims FROM dev_gold WHERE len(expected_claims) > 0 GROUP BY id),
p AS (SELECT DISTINCT run_id, example_id, lower(trim(regexp_replace(answer, '\\s+', ' ', 'g'))) AS a FROM per_example WHERE answer IS NOT NULL)
SELECT run_id, example_id, CAST(len(claims) AS BIGINT) AS wanted, CAST(len(list_filter(claims, lambda c: contains(a, lower(trim(regexp_replace(c, '\\s+', ' ', 'g')))))) AS BIGINT) AS found FROM p JOIN g ON g.id = p.example_id"""
)
def claim_evidence(spark, directory) -> DataFrame:
    """FLT-19, STR-07, CLS-04: expected claims that stand in the answer, white space and case evened."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    g = once(table(spark, directory, "dev_gold").select(F.col("id").alias("example_id"), "expected_claims").filter(F.size("expected_claims") > 0), ["example_id"])
    p = table(spark, directory, "per_example").filter("answer IS NOT NULL").select("run_id", "example_id", norm(F.col("answer")).alias("a")).distinct()
    found = F.filter("expected_claims", lambda c: F.contains(F.col("a"), norm(c)))
    return p.join(g, "example_id").select("run_id", "example_id", F.size("expected_claims").cast("bigint").alias("wanted"), F.size(found).cast("bigint").alias("found"))


@R.query(
    f"WITH {_GOLD_SQL}, top AS (SELECT DISTINCT query_id, chunk_id, video_id, start_sec, end_sec, rank FROM channel_results WHERE rank IS NOT NULL AND end_sec > start_sec),"
    + """ x AS (SELECT g.query_id, top.chunk_id, top.rank, greatest(0, least(top.end_sec, g_end) - greatest(top.start_sec, g_start)) / (g_end - g_start) AS ratio FROM g JOIN top ON g.query_id = top.query_id AND g.g_video = top.video_id),
b AS (SELECT query_id, chunk_id, ratio, row_number() OVER (PARTITION BY query_id ORDER BY ratio DESC, rank, chunk_id) AS n FROM x)
SELECT query_id, chunk_id, round(ratio, 6) AS ratio, ratio >= 0.5 AS valid FROM b WHERE n = 1"""
)
def cite_best_overlap(spark, directory) -> DataFrame:
    """JOIN-13, FLT-22: for each interval the ranked chunk that covers most of it, first of equals."""
    top = _results(spark, directory)
    gold = _gold(spark, directory)
    pairs = top.join(gold, (top.query_id == gold.query_id) & (top.video_id == gold.g_video)).drop(gold.query_id)
    ratio = F.greatest(F.lit(0.0), F.least("end_sec", "g_end") - F.greatest("start_sec", "g_start")) / (F.col("g_end") - F.col("g_start"))
    best = pairs.withColumn("ratio", ratio).groupBy("query_id").agg(F.max_by(F.struct("chunk_id", "ratio"), F.struct("ratio", -F.col("rank"), -F.col("chunk_id"))).alias("m"))
    return best.select("query_id", "m.chunk_id", F.round("m.ratio", 6).alias("ratio"), (F.col("m.ratio") >= 0.5).alias("valid"))


@R.query(
    """WITH x AS (SELECT DISTINCT query_id, frame_id, score, rank FROM frame_results),
b AS (SELECT query_id, count(*) AS frames, count(score) AS scored, max(score) AS best, min(score) AS worst FROM x GROUP BY query_id)
SELECT query_id, frames, scored, round(best, 6) AS best, round(worst, 6) AS worst FROM b"""
)
def frame_search_summary(spark, directory) -> DataFrame:
    """PRJ-02, AGG-15: recorded frame searches, one line a query."""
    x = table(spark, directory, "frame_results").select("query_id", "frame_id", "score", "rank").distinct()
    return x.groupBy("query_id").agg(F.count("*").alias("frames"), F.count("score").alias("scored"), F.round(F.max("score"), 6).alias("best"), F.round(F.min("score"), 6).alias("worst"))
