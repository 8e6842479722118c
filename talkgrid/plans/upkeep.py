"""Queries for validation, readiness, referential checks, upserts and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.functions.columns import tenths
from talkgrid.operators import merge
from talkgrid.operators.intervals import valid_span
from talkgrid.plans.registry import Registry
from talkgrid.tables import once, table

R = Registry()
#: Tags of talks that need frames.
VISUAL_TAGS = ("slides_heavy", "code_heavy", "whiteboard", "live_demo", "diagram")


@R.query(
    """WITH c AS (SELECT video_id, chunking_strategy, count(DISTINCT chunk_id) AS chunks FROM chunks GROUP BY ALL),
d AS (SELECT video_id, chunking_strategy, count(DISTINCT d.chunk_id) AS dense FROM dense_embeds d JOIN (SELECT DISTINCT chunk_id, video_id, chunking_strategy FROM chunks) USING (chunk_id) WHERE dense IS NOT NULL GROUP BY ALL),
f AS (SELECT video_id, count(DISTINCT frame_id) AS frames, count(DISTINCT CASE WHEN pooled_embedding IS NOT NULL THEN frame_id END) AS pooled FROM frame_samples GROUP BY video_id)
SELECT video_id, chunking_strategy, chunks, coalesce(dense, 0) AS dense, coalesce(frames, 0) AS frames, coalesce(pooled, 0) AS pooled, chunks = coalesce(dense, 0) AND coalesce(frames, 0) = coalesce(pooled, 0) AS ready
FROM c LEFT JOIN d USING (video_id, chunking_strategy) LEFT JOIN f USING (video_id)"""
)
def readiness_report(spark, directory) -> DataFrame:
    """JOIN-05, AGG-15, AGG-16, AGG-17, AGG-34: per video and strategy, what is embedded and whether all is."""
    chunks = table(spark, directory, "chunks").select("chunk_id", "video_id", "chunking_strategy").distinct()
    c = chunks.groupBy("video_id", "chunking_strategy").agg(F.countDistinct("chunk_id").alias("chunks"))
    have = table(spark, directory, "dense_embeds").filter("dense IS NOT NULL").select("chunk_id").distinct()
    d = chunks.join(have, "chunk_id").groupBy("video_id", "chunking_strategy").agg(F.countDistinct("chunk_id").alias("dense"))
    per = table(spark, directory, "frame_samples").groupBy("video_id", "frame_id").agg(F.max(F.col("pooled_embedding").isNotNull().cast("int")).alias("p"))
    f = per.groupBy("video_id").agg(F.count("frame_id").alias("frames"), F.sum(F.when(F.col("frame_id").isNotNull(), F.col("p"))).alias("pooled"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).alias(x)
    out = c.join(d, ["video_id", "chunking_strategy"], "left").join(f, "video_id", "left").select("video_id", "chunking_strategy", "chunks", zero("dense"), zero("frames"), zero("pooled"))
    return out.withColumn("ready", (F.col("chunks") == F.col("dense")) & (F.col("frames") == F.col("pooled")))


@R.query(
    """SELECT channel, count(DISTINCT r.chunk_id) AS chunks, count(DISTINCT CASE WHEN d.chunk_id IS NULL THEN r.chunk_id END) AS without_vector
FROM channel_results r LEFT JOIN (SELECT DISTINCT chunk_id FROM dense_embeds WHERE dense IS NOT NULL) d ON d.chunk_id = r.chunk_id GROUP BY channel"""
)
def embed_alignment(spark, directory) -> DataFrame:
    """JOIN-07, AGG-16: chunks that a channel returned and those among them without a vector."""
    r = table(spark, directory, "channel_results").select("channel", "chunk_id").distinct()
    have = table(spark, directory, "dense_embeds").filter("dense IS NOT NULL").select("chunk_id", F.lit(1).alias("v")).distinct()
    return r.join(have, "chunk_id", "left").groupBy("channel").agg(F.count("chunk_id").alias("chunks"), F.count(F.when(F.col("v").isNull(), F.col("chunk_id"))).alias("without_vector"))


@R.query(
    """WITH g AS (SELECT id, video_id FROM dev_gold WHERE video_id IS NOT NULL UNION SELECT id, s.video_id FROM (SELECT id, unnest(gold_spans) AS s FROM dev_gold) WHERE s.video_id IS NOT NULL)
SELECT DISTINCT id, video_id FROM g ANTI JOIN chunks USING (video_id)"""
)
def unknown_videos(spark, directory) -> DataFrame:
    """JOIN-15, SET-06: videos that gold records name and no chunk has."""
    g = table(spark, directory, "dev_gold")
    named = g.select("id", "video_id").unionByName(g.select("id", F.explode("gold_spans").alias("s")).select("id", F.col("s.video_id").alias("video_id"))).filter("video_id IS NOT NULL").distinct()
    return named.join(table(spark, directory, "chunks").select("video_id").distinct(), "video_id", "left_anti").select("id", "video_id")


@R.query(
    """WITH r AS (SELECT DISTINCT id,
  question IS NULL OR trim(question) = '' AS no_question,
  question_type = 'negative' AND len(gold_spans) > 0 AS negative_with_span,
  question_type = 'single_clip' AND coalesce(len(gold_spans), 0) <> 1 AS single_without_one_span,
  question_type = 'synthesis' AND coalesce(len(gold_spans), 0) < 2 AS synthesis_without_two,
  coalesce(len(list_filter(gold_spans, lambda s: s.end_sec <= s.start_sec)) > 0, false) AS span_backwards,
  lower(trim(split)) NOT IN ('train', 'dev', 'test') AS odd_split, NOT verified AS unverified FROM dev_gold)
SELECT rule, count(*) AS records FROM (
  SELECT id, unnest(list_filter([CASE WHEN no_question THEN 'no_question' END, CASE WHEN negative_with_span THEN 'negative_with_span' END, CASE WHEN single_without_one_span THEN 'single_without_one_span' END,
    CASE WHEN synthesis_without_two THEN 'synthesis_without_two' END, CASE WHEN span_backwards THEN 'span_backwards' END, CASE WHEN odd_split THEN 'odd_split' END, CASE WHEN unverified THEN 'unverified' END], lambda x: x IS NOT NULL)) AS rule FROM r)
GROUP BY rule"""
)
def gold_violations(spark, directory) -> DataFrame:
    """VAL-02, FLT-20: rules that gold records break."""
    g = table(spark, directory, "dev_gold")
    n = F.coalesce(F.size("gold_spans"), F.lit(0))
    n = F.when(F.col("gold_spans").isNull(), 0).otherwise(n)
    kind = F.col("question_type")
    rules = {
        "no_question": F.col("question").isNull() | (F.trim("question") == ""), "negative_with_span": (kind == "negative") & (n > 0), "single_without_one_span": (kind == "single_clip") & (n != 1),
        "synthesis_without_two": (kind == "synthesis") & (n < 2), "span_backwards": F.coalesce(F.exists("gold_spans", lambda s: s["end_sec"] <= s["start_sec"]), F.lit(False)),
        "odd_split": ~F.lower(F.trim("split")).isin("train", "dev", "test"), "unverified": ~F.col("verified"),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    flags = g.select("id", *[F.coalesce(c, F.lit(None).cast("boolean")).alias(k) for k, c in rules.items()], broken.alias("b")).distinct()
    return flags.select(F.explode("b").alias("rule")).groupBy("rule").agg(F.count("*").alias("records"))


@R.query("SELECT chunk_id, count(*) AS rows FROM chunks GROUP BY chunk_id HAVING count(*) > 1")
def redelivered_chunks(spark, directory) -> DataFrame:
    """Uniqueness check: chunk ids delivered more than once."""
    return merge.duplicate_keys(table(spark, directory, "chunks"), ["chunk_id"])


@R.query(
    """SELECT chunk_id, video_id, round(start_sec, 6) AS start_sec, created_at FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC, video_id DESC) AS n FROM chunks WHERE created_at IS NOT NULL) WHERE n = 1"""
)
def latest_chunks(spark, directory) -> DataFrame:
    """TOPK-05: last delivery of every chunk."""
    c = table(spark, directory, "chunks").filter("created_at IS NOT NULL").select("chunk_id", "video_id", "start_sec", "created_at")
    return merge.latest(c, ["chunk_id"], F.col("created_at"), [F.col("video_id")]).select("chunk_id", "video_id", F.round("start_sec", 6).alias("start_sec"), "created_at")


@R.query(
    """WITH c AS (SELECT chunk_id, token_count AS n, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC NULLS LAST, token_count DESC NULLS LAST) AS r FROM chunks WHERE chunk_id IS NOT NULL)
SELECT chunk_id, n FROM c WHERE r = 1"""
)
def upsert_keep_latest(spark, directory) -> DataFrame:
    """SNK-01..SNK-04, STM-08: first deliveries of all chunks, replaced by the latest of those delivered again."""
    c = table(spark, directory, "chunks").filter("chunk_id IS NOT NULL").select("chunk_id", "created_at", F.col("token_count").alias("n"))
    at = F.struct("created_at", "n")
    ends = c.groupBy("chunk_id").agg(F.count("*").alias("rows"), F.min_by("n", at).alias("first"), F.max_by("n", at).alias("last"))
    return merge.upsert(ends.select("chunk_id", F.col("first").alias("n")), ends.filter("rows > 1").select("chunk_id", F.col("last").alias("n")), ["chunk_id"])


@R.query(
    """WITH t AS (SELECT frame_id, min(sha256) AS sha, max(pooled_embedding IS NOT NULL) AS pooled FROM frame_samples GROUP BY frame_id), s AS (SELECT frame_id, 'new' AS sha, NULL AS pooled FROM t WHERE frame_id % 5 = 0 UNION ALL SELECT -1, 'new', NULL)
SELECT coalesce(t.frame_id, s.frame_id) AS frame_id, CASE WHEN s.frame_id IS NOT NULL THEN s.sha ELSE t.sha END AS sha, coalesce(t.pooled, s.pooled) AS pooled FROM t FULL JOIN s ON t.frame_id = s.frame_id"""
)
def upsert_keeping_vectors(spark, directory) -> DataFrame:
    """SNK-06, SNK-07: an upsert that never takes a stored vector away."""
    t = table(spark, directory, "frame_samples").groupBy("frame_id").agg(F.min("sha256").alias("sha"), F.max(F.col("pooled_embedding").isNotNull()).alias("pooled"))
    extra = spark.createDataFrame([(-1,)], "frame_id bigint")
    s = t.filter("frame_id % 5 = 0").select("frame_id").unionByName(extra).select("frame_id", F.lit("new").alias("sha"), F.lit(None).cast("boolean").alias("pooled"))
    return merge.upsert(t, s, ["frame_id"], keep=["pooled"])


@R.query(
    """WITH p AS (SELECT DISTINCT chunk_id, n, x FROM (SELECT chunk_id, unnest(range(len(frame_secs))) AS n, unnest(frame_secs) AS x FROM chunks)), s AS (SELECT chunk_id, 0 AS n, CAST(-1 AS DOUBLE) AS x FROM p WHERE chunk_id % 4 = 0 GROUP BY chunk_id)
SELECT chunk_id, CAST(n AS BIGINT) AS position, x AS value FROM p ANTI JOIN s USING (chunk_id) UNION ALL SELECT chunk_id, n, x FROM s"""
)
def replace_children(spark, directory) -> DataFrame:
    """SNK-05, SNK-08, SNK-09, SNK-17: all children of a parent replaced by new ones."""
    kids = table(spark, directory, "chunks").select("chunk_id", F.posexplode("frame_secs").alias("position", "value")).select("chunk_id", F.col("position").cast("bigint").alias("position"), "value").distinct()
    new = kids.filter("chunk_id % 4 = 0").select("chunk_id").distinct().select("chunk_id", F.lit(0).cast("bigint").alias("position"), F.lit(-1.0).alias("value"))
    return merge.replace_children(kids, new, "chunk_id")


@R.query("SELECT DISTINCT d.chunk_id FROM dense_embeds d SEMI JOIN (SELECT chunk_id FROM chunks WHERE chunking_strategy = 'fixed_window') c USING (chunk_id)")
def delete_cascade(spark, directory) -> DataFrame:
    """JOIN-16, FLT-05, FLT-17: vectors that stay when all chunks of the other strategy are deleted."""
    left = table(spark, directory, "chunks").filter("chunking_strategy = 'fixed_window'")
    return merge.delete_cascade(table(spark, directory, "dense_embeds").select("chunk_id"), left, "chunk_id").distinct()


@R.query(
    """WITH p AS (SELECT DISTINCT run_id, example_id, metrics FROM per_example WHERE metrics IS NOT NULL AND json_valid(metrics))
SELECT run_id, example_id, json_extract_string(metrics, '$.latency_ms') AS latency, 'yes' AS locked, NOT json_contains(json_keys(metrics)::JSON, '"locked"') AS added FROM p"""
)
def json_patch(spark, directory) -> DataFrame:
    """SNK-13, JSN-08, MAP-01: metrics documents with a key merged in."""
    p = table(spark, directory, "per_example").filter("metrics IS NOT NULL AND try_parse_json(metrics) IS NOT NULL").select("run_id", "example_id", "metrics").distinct()
    doc = merge.json_patch(F.col("metrics"), F.lit('{"locked": "yes"}'))
    had = F.map_contains_key(F.from_json("metrics", "map<string,string>"), "locked")
    return p.select("run_id", "example_id", doc["latency_ms"].alias("latency"), doc["locked"].alias("locked"), (~had).alias("added"))


@R.query("SELECT frame_id, sha256(image_path) AS path_sha, substr(sha256(image_path), 1, 12) AS short FROM (SELECT DISTINCT frame_id, image_path FROM frame_samples WHERE image_path IS NOT NULL)")
def path_hash(spark, directory) -> DataFrame:
    """HSH-01, STR-17: hashes of frame paths, whole and short."""
    f = table(spark, directory, "frame_samples").filter("image_path IS NOT NULL").select("frame_id", "image_path").distinct()
    return f.select("frame_id", F.sha2("image_path", 256).alias("path_sha"), F.substring(F.sha2("image_path", 256), 1, 12).alias("short"))


@R.query("SELECT sha256, count(DISTINCT frame_id) AS frames, count(DISTINCT video_id) AS videos FROM frame_samples WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(DISTINCT frame_id) > 1")
def repeated_pictures(spark, directory) -> DataFrame:
    """SRC-13, AGG-16: pictures that stand under several frames."""
    f = table(spark, directory, "frame_samples").filter("sha256 IS NOT NULL").groupBy("sha256", "frame_id").agg(F.min("video_id").alias("video_id"))
    return f.groupBy("sha256").agg(F.count("frame_id").alias("frames"), F.countDistinct("video_id").alias("videos")).filter("frames > 1")


@R.query("SELECT DISTINCT id, question_type, list_contains(tags, 'visual') AS tagged, len(list_intersect(tags, ['visual', 'captions', 'slides_heavy', 'code_heavy', 'whiteboard', 'live_demo', 'diagram'])) > 0 AS needs_frames FROM dev_gold WHERE tags IS NOT NULL")
def tag_overlap(spark, directory) -> DataFrame:
    """FLT-10, FLT-11, SET-03: gold records with a tag, and with any tag of those that need frames."""
    g = table(spark, directory, "dev_gold").filter("tags IS NOT NULL")
    wanted = F.array(*[F.lit(t) for t in ("visual", "captions", *VISUAL_TAGS)])
    return g.select("id", "question_type", F.array_contains("tags", "visual").alias("tagged"), F.arrays_overlap("tags", wanted).alias("needs_frames")).distinct()


@R.query(
    """WITH c AS (SELECT DISTINCT chunk_id, video_id, start_sec, end_sec, text FROM chunks WHERE end_sec > start_sec AND isfinite(start_sec) AND isfinite(end_sec) AND text IS NOT NULL)
SELECT chunk_id, '[' || video_id || ' @ ' || printf('%.1f', start_sec) || '-' || printf('%.1f', end_sec) || ']' || chr(10) || text AS context FROM c WHERE video_id IS NOT NULL"""
)
def rendered_context(spark, directory) -> DataFrame:
    """PRJ-05: chunks as lines of a prompt, times with one decimal."""
    c = table(spark, directory, "chunks").filter(valid_span(F.col("start_sec"), F.col("end_sec")) & F.col("text").isNotNull() & F.col("video_id").isNotNull()).select("chunk_id", "video_id", "start_sec", "end_sec", "text").distinct()
    return c.select("chunk_id", F.format_string("[%s @ %s-%s]\n%s", "video_id", tenths(F.col("start_sec")), tenths(F.col("end_sec")), "text").alias("context"))


@R.query(
    """WITH e AS (SELECT user_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n, event_id FROM events)
SELECT user_id, event_type, event_id, round(value, 6) AS value FROM e WHERE n = 1"""
)
def latest_event(spark, directory) -> DataFrame:
    """State of every (user, kind) after all events: the last one."""
    e = table(spark, directory, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return merge.latest(e, ["user_id", "event_type"], F.col("ts"), [F.col("event_id")]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@R.query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_by_hour(spark, directory) -> DataFrame:
    """Batch form of the windowed stream of ``streaming.events``."""
    e = table(spark, directory, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))


@R.query(
    """WITH p AS (SELECT run_id, count(*) AS rows, count(DISTINCT example_id) AS examples, min(completed_at) AS first_at, max(completed_at) AS last_at FROM per_example GROUP BY run_id) SELECT * FROM p"""
)
def run_summary(spark, directory) -> DataFrame:
    """AGG-27: rows, examples and time of each run."""
    return table(spark, directory, "per_example").groupBy("run_id").agg(F.count("*").alias("rows"), F.countDistinct("example_id").alias("examples"), F.min("completed_at").alias("first_at"), F.max("completed_at").alias("last_at"))


@R.query(
    """WITH g AS (SELECT id, any_value(verified) AS v, any_value(question_type) AS t, any_value(coalesce(gold_spans[1].video_id, video_id)) AS video FROM dev_gold GROUP BY id)
SELECT count(*) FILTER (v AND t <> 'negative') AS verified, count(DISTINCT CASE WHEN v AND t <> 'negative' THEN video END) AS talks, count(*) FILTER (v AND t <> 'negative') >= 20 AND count(DISTINCT CASE WHEN v AND t <> 'negative' THEN video END) >= 3 AS enough FROM g"""
)
def gold_counts(spark, directory) -> DataFrame:
    """AGG-29, CFG-02: verified records and the talks they cover."""
    first = F.get(F.col("gold_spans"), 0)
    g = once(table(spark, directory, "dev_gold").select("id", "verified", "question_type", F.coalesce(first["video_id"], F.col("video_id")).alias("video")), ["id"])
    own = F.col("verified") & (F.col("question_type") != "negative")
    out = g.agg(F.count(F.when(own, 1)).alias("verified"), F.countDistinct(F.when(own, F.col("video"))).alias("talks"))
    return out.withColumn("enough", (F.col("verified") >= 20) & (F.col("talks") >= 3))
