"""Queries that look up, order, name and format rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkgrid.operators.vectors import top_k
from talkgrid.plans.registry import Registry
from talkgrid.tables import once, small, table

R = Registry()


@R.query(
    """WITH q AS (SELECT DISTINCT query_id, chunk_id, video_id FROM reranked_results WHERE chunk_id IS NOT NULL), c AS (SELECT DISTINCT chunk_id, video_id FROM chunks WHERE chunk_id IS NOT NULL AND video_id IS NOT NULL)
SELECT query_id, q.chunk_id, c.chunk_id IS NOT NULL AS found FROM q LEFT JOIN c ON q.chunk_id = c.chunk_id AND q.video_id = c.video_id"""
)
def scoped_lookup(spark, directory) -> DataFrame:
    """FLT-16: chunks looked up by id and video, absent when either differs."""
    q = table(spark, directory, "reranked_results").filter("chunk_id IS NOT NULL").select("query_id", "chunk_id", "video_id").distinct()
    c = table(spark, directory, "chunks").filter("chunk_id IS NOT NULL AND video_id IS NOT NULL").select("chunk_id", "video_id", F.lit(True).alias("f")).distinct()
    return q.join(c, ["chunk_id", "video_id"], "left").select("query_id", "chunk_id", F.coalesce("f", F.lit(False)).alias("found"))


@R.query(
    """WITH r AS (SELECT query_id, chunk_id, min(rank) AS rank FROM reranked_results WHERE rank <= 8 AND chunk_id IS NOT NULL GROUP BY ALL)
SELECT query_id, array_to_string(list(chunk_id ORDER BY rank, chunk_id), ',') AS chunk_ids, count(*) AS chunks, '{' || string_agg('"' || chunk_id || '":' || rank, ',' ORDER BY chunk_id) || '}' AS ranks_json FROM r GROUP BY query_id"""
)
def state_snapshot(spark, directory) -> DataFrame:
    """PRJ-01, JSN-06, JSN-07: the state of a query as ids in order, and its ranks as JSON with the ids as text keys."""
    r = table(spark, directory, "reranked_results").filter("rank <= 8 AND chunk_id IS NOT NULL").groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))
    own = r.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("by_rank"), F.array_sort(F.collect_list(F.struct("chunk_id", "rank"))).alias("by_id"))
    keys = F.map_from_entries(F.transform("by_id", lambda x: F.struct(x["chunk_id"].cast("string"), x["rank"])))
    return own.select("query_id", F.array_join(F.transform("by_rank", lambda x: x["chunk_id"].cast("string")), ",").alias("chunk_ids"), F.size("by_rank").cast("bigint").alias("chunks"), F.to_json(keys).alias("ranks_json"))


@R.query(
    """WITH v AS (SELECT chunk_id, CAST(min(dense) AS DOUBLE[]) AS v FROM dense_embeds WHERE chunk_id IS NOT NULL AND dense IS NOT NULL AND len(list_filter(dense, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY chunk_id),
n AS (SELECT chunk_id, v, greatest(sqrt(list_inner_product(v, v)), 1e-12) AS norm FROM v)
SELECT chunk_id, CAST(len(v) AS INT) AS dims, round(norm, 5) AS norm, round(list_inner_product(list_transform(v, lambda x: x / norm), list_transform(v, lambda x: x / norm)), 6) AS squared FROM n"""
)
def normalized_vectors(spark, directory) -> DataFrame:
    """VEC-04, VEC-07: vectors divided by their length (at least 1e-12), and their dimension."""
    ok = F.forall("dense", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 3.0e38))
    v = table(spark, directory, "dense_embeds").filter(F.col("chunk_id").isNotNull() & F.col("dense").isNotNull() & ok).groupBy("chunk_id").agg(F.min("dense").cast("array<double>").alias("v"))
    dot = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)
    n = v.withColumn("norm", F.greatest(F.sqrt(dot("v")), F.lit(1e-12)))
    return n.select("chunk_id", F.size("v").alias("dims"), F.round("norm", 5).alias("norm"), F.round(dot(F.zip_with("v", F.array_repeat("norm", F.size("v")), lambda x, by: x / by)), 6).alias("squared"))


@R.query("SELECT DISTINCT video_id FROM documents ANTI JOIN (SELECT DISTINCT video_id FROM chunks WHERE video_id IS NOT NULL) USING (video_id) WHERE video_id IS NOT NULL ORDER BY video_id")
def pending_videos(spark, directory) -> DataFrame:
    """JOIN-17, SNK-20, TOPK-07: discovered and not yet done, in a fixed order."""
    have = table(spark, directory, "chunks").filter("video_id IS NOT NULL").select("video_id").distinct()
    return table(spark, directory, "documents").filter("video_id IS NOT NULL").select("video_id").distinct().join(have, "video_id", "left_anti").orderBy("video_id")


@R.query(
    """WITH f AS (SELECT frame_id, min(video_id) AS video_id, max(len(pooled_embedding) // 8) AS patches FROM frame_samples WHERE frame_id IS NOT NULL GROUP BY frame_id)
SELECT video_id, count(*) AS frames, CAST(coalesce(sum(patches), 0) AS BIGINT) AS patches FROM f GROUP BY video_id"""
)
def patch_counts(spark, directory) -> DataFrame:
    """JOIN-06: frames and patches of every video; a patch is eight components of the pooled vector."""
    rows = table(spark, directory, "frame_samples").filter("frame_id IS NOT NULL")
    frames = rows.groupBy("frame_id").agg(F.min("video_id").alias("video_id"), F.max(F.when(F.col("pooled_embedding").isNotNull(), F.size("pooled_embedding"))).alias("dims"))
    patches = frames.select("frame_id", F.explode(F.when(F.col("dims") >= 8, F.sequence(F.lit(1), F.floor(F.col("dims") / 8).cast("int")))).alias("patch"))
    held = patches.join(frames.select("frame_id", "video_id"), "frame_id").groupBy(F.col("video_id").alias("v")).agg(F.count("*").alias("patches"))
    per = frames.groupBy("video_id").agg(F.count("*").alias("frames"))
    return per.join(held, per.video_id.eqNullSafe(held.v), "left").select("video_id", "frames", F.coalesce("patches", F.lit(0)).alias("patches"))


_FIRST_SQL = "SELECT run_id, generator, example_id, max(CAST(coalesce(abstain, false) AS INT)) AS abstains, max(completed_at) AS done_at FROM per_example WHERE run_id IS NOT NULL AND example_id IS NOT NULL GROUP BY ALL"


@R.query(
    f"""WITH o AS ({_FIRST_SQL}), n AS (SELECT *, lag(abstains) OVER w AS prior, lag(run_id) OVER w AS prior_run FROM o WINDOW w AS (PARTITION BY generator, example_id ORDER BY done_at, run_id))
SELECT run_id, generator, example_id, abstains, prior, prior IS NOT NULL AND prior <> abstains AS changed FROM n"""
)
def prior_flags(spark, directory) -> DataFrame:
    """JOIN-20, WIN-10: answers beside the flag of the run before."""
    o = table(spark, directory, "per_example").filter("run_id IS NOT NULL AND example_id IS NOT NULL").groupBy("run_id", "generator", "example_id").agg(F.max(F.coalesce("abstain", F.lit(False)).cast("int")).alias("abstains"), F.max("completed_at").alias("done_at"))
    prior = F.lag("abstains").over(W.partitionBy("generator", "example_id").orderBy("done_at", "run_id"))
    return o.withColumn("prior", prior).select("run_id", "generator", "example_id", "abstains", "prior", F.coalesce(F.col("prior") != F.col("abstains"), F.lit(False)).alias("changed"))


@R.query(
    """WITH o AS (SELECT generator, set_name, run_id, max(completed_at) AS done_at FROM per_example WHERE run_id IS NOT NULL AND completed_at IS NOT NULL GROUP BY ALL)
SELECT generator, set_name, arg_max(run_id, (done_at, run_id)) AS run_id, max(done_at) AS done_at, count(*) AS runs, count(*) = 1 AS only_one FROM o GROUP BY generator, set_name"""
)
def latest_runs(spark, directory) -> DataFrame:
    """AGG-32, WIN-10, JOIN-22, SRC-12: last run of every generator and set, and whether the lookup is unique."""
    o = table(spark, directory, "per_example").filter("run_id IS NOT NULL AND completed_at IS NOT NULL").groupBy("generator", "set_name", "run_id").agg(F.max("completed_at").alias("done_at"))
    return o.groupBy("generator", "set_name").agg(F.max_by("run_id", F.struct("done_at", "run_id")).alias("run_id"), F.max("done_at").alias("done_at"), F.count("*").alias("runs")).withColumn("only_one", F.col("runs") == 1)


#: Words that are no part of a speaker's name.
NOT_A_NAME = ("the", "of", "and", "for", "with", "team", "labs", "co")
#: Fixed value: words with which a question asks for more than one talk.
SYNTHESIS_CUE = r"\b(compare|contrast|both|and\s+\w+\s+(say|argue|claim|argues|says|claims))\b"
_NOT = ", ".join(f"'{w}'" for w in NOT_A_NAME)


@R.query(
    f"""WITH s AS (SELECT DISTINCT regexp_replace(talk_title, ' in practice$', ' (in practice)') AS speaker FROM dev_gold WHERE talk_title IS NOT NULL),
t AS (SELECT speaker, list_filter(string_split_regex(lower(trim(regexp_replace(speaker, '\\s*\\([^)]*\\)\\s*$', ''))), '[\\s\\-]+'), lambda w: length(w) >= 3 AND w NOT IN ({_NOT})) AS toks FROM s),
q AS (SELECT DISTINCT id, question FROM dev_gold WHERE question IS NOT NULL AND id IS NOT NULL),
m AS (SELECT id, question, count(*) FILTER (len(list_filter(toks, lambda w: contains(lower(question), w))) > 0) AS mentions FROM q, t GROUP BY ALL)
SELECT id, question, mentions, CASE WHEN regexp_matches(lower(question), '{SYNTHESIS_CUE}') OR mentions >= 2 THEN 'synthesis' ELSE 'single_clip' END AS planned FROM m"""
)
def speaker_mentions(spark, directory) -> DataFrame:
    """STR-11, STR-12, AGG-33, LOP-01: subjects named in a question, each once, and the kind of question planned from cues and mentions."""
    gold = table(spark, directory, "dev_gold")
    name = F.regexp_replace(F.regexp_replace("talk_title", " in practice$", " (in practice)"), r"\s*\([^)]*\)\s*$", "")
    toks = F.filter(F.split(F.lower(F.trim(name)), r"[\s\-]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*NOT_A_NAME))
    # the names of one corpus are one row of arrays, put beside the questions only behind a check of their size
    names = gold.filter("talk_title IS NOT NULL").select(toks.alias("toks"), "talk_title").distinct().agg(F.collect_list("toks").alias("all"))
    q = gold.filter("question IS NOT NULL AND id IS NOT NULL").select("id", "question").distinct()
    hit = F.filter("all", lambda own: F.exists(own, lambda w: F.contains(F.lower(F.col("question")), w)))
    rows = q.crossJoin(small(names)).select("id", "question", F.size(hit).cast("bigint").alias("mentions"))
    return rows.withColumn("planned", F.when(F.lower("question").rlike(SYNTHESIS_CUE) | (F.col("mentions") >= 2), "synthesis").otherwise("single_clip"))


@R.query(
    """SELECT coalesce(video_id, 'none') AS source, max(end_sec) + 30 AS end_sec, count(DISTINCT chunk_id) AS chunks, 'videos/talks/' || coalesce(video_id, 'none') || '.mp4' AS path
FROM chunks WHERE end_sec IS NOT NULL AND isfinite(end_sec) GROUP BY coalesce(video_id, 'none')"""
)
def download_plan(spark, directory) -> DataFrame:
    """SRC-17, PTH-01, SET-07: one entry a source, to 30 s behind its last chunk, and its path."""
    c = table(spark, directory, "chunks").filter("end_sec IS NOT NULL AND NOT isnan(end_sec) AND abs(end_sec) < 1e300")
    per = c.groupBy(F.coalesce("video_id", F.lit("none")).alias("source")).agg((F.max("end_sec") + 30).alias("end_sec"), F.countDistinct("chunk_id").alias("chunks"))
    return per.select("*", F.concat(F.lit("videos/talks/"), "source", F.lit(".mp4")).alias("path"))


@R.query(
    """WITH c AS (SELECT video_id, count(DISTINCT chunk_id) AS chunks FROM chunks WHERE video_id IS NOT NULL GROUP BY video_id), d AS (SELECT video_id, count(DISTINCT d.chunk_id) AS dense FROM dense_embeds d JOIN (SELECT DISTINCT chunk_id, video_id FROM chunks) USING (chunk_id) WHERE dense IS NOT NULL AND video_id IS NOT NULL GROUP BY video_id)
SELECT video_id, CASE WHEN coalesce(dense, 0) >= chunks THEN '✓ ' ELSE '✗ ' END || coalesce(dense, 0) || '/' || chunks AS cell, CASE WHEN dense IS NULL THEN 'not embedded' WHEN dense < chunks THEN 'partly embedded' ELSE 'ready' END AS status FROM c LEFT JOIN d USING (video_id)"""
)
def readiness_cells(spark, directory) -> DataFrame:
    """RPT-01, AGG-34: readiness of a video as a cell and a status."""
    ids = table(spark, directory, "chunks").filter("video_id IS NOT NULL").select("chunk_id", "video_id").distinct()
    c = ids.groupBy("video_id").agg(F.countDistinct("chunk_id").alias("chunks"))
    have = table(spark, directory, "dense_embeds").filter("dense IS NOT NULL").select("chunk_id").distinct()
    d = ids.join(have, "chunk_id").groupBy("video_id").agg(F.countDistinct("chunk_id").alias("dense"))
    n = F.coalesce("dense", F.lit(0))
    cell = F.concat(F.when(n >= F.col("chunks"), "✓ ").otherwise("✗ "), n.cast("string"), F.lit("/"), F.col("chunks").cast("string"))
    return c.join(d, "video_id", "left").select("video_id", cell.alias("cell"), F.when(F.col("dense").isNull(), "not embedded").when(F.col("dense") < F.col("chunks"), "partly embedded").otherwise("ready").alias("status"))


@R.query("SELECT doc_id, length(text) AS n, CASE WHEN length(text) < 200 THEN 'below' WHEN length(text) > 2000 THEN 'above' ELSE 'inside' END AS band, substr(text, 1, 200) AS excerpt FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)")
def length_bands(spark, directory) -> DataFrame:
    """CMP-16, STR-17: sizes below, inside and above a band, with an excerpt."""
    d = table(spark, directory, "documents").filter("text IS NOT NULL").select("doc_id", "text").distinct()
    n = F.length("text")
    return d.select("doc_id", n.cast("bigint").alias("n"), F.when(n < 200, "below").when(n > 2000, "above").otherwise("inside").alias("band"), F.substring("text", 1, 200).alias("excerpt"))


@R.query(
    """WITH r AS (SELECT DISTINCT query_id, channel, chunk_id FROM channel_results WHERE rank = 1), g AS (SELECT channel, count(*) AS n, count(*) FILTER (chunk_id % 2 = 0) AS k FROM r GROUP BY channel)
SELECT '| ' || channel || ' | ' || k || '/' || n || ' (' || CAST(round_even(100.0 * k / n, 0) AS INT) || '%) |' AS line FROM g"""
)
def report_lines(spark, directory) -> DataFrame:
    """CMP-12, SNK-18: rates as lines of a Markdown table."""
    r = table(spark, directory, "channel_results").filter("rank = 1").select("query_id", "channel", "chunk_id").distinct()
    g = r.groupBy("channel").agg(F.count("*").alias("n"), F.count(F.when(F.col("chunk_id") % 2 == 0, 1)).alias("k"))
    return g.select(F.format_string("| %s | %d/%d (%d%%) |", "channel", "k", "n", F.bround(F.lit(100.0) * F.col("k") / F.col("n")).cast("int")).alias("line"))


@R.query(
    """WITH r AS (SELECT query_id, 'q0:' || channel AS name, chunk_id, min(rank) AS rank FROM channel_results WHERE rank IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL
UNION ALL SELECT query_id, 'q1:rerank', chunk_id, min(rank) FROM reranked_results WHERE rank IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL),
f AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score, string_agg(name, ',' ORDER BY name) AS names FROM r GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f) WHERE rank <= 30"""
)
def subquery_fusion(spark, directory) -> DataFrame:
    """SET-02, LOP-02: lists of several sub-queries under their own names, fused to 30."""
    c = table(spark, directory, "channel_results").select("query_id", F.concat(F.lit("q0:"), "channel").alias("name"), "chunk_id", "rank")
    x = table(spark, directory, "reranked_results").select("query_id", F.lit("q1:rerank").alias("name"), "chunk_id", "rank")
    one = c.unionByName(x).filter("rank IS NOT NULL AND chunk_id IS NOT NULL").groupBy("query_id", "name", "chunk_id").agg(F.min("rank").alias("r"))
    fused = one.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (60 + F.col("r"))), 9).alias("score"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    return top_k(fused, ["query_id"], "score", "chunk_id", 30)


@R.query("WITH f AS (SELECT DISTINCT query_id, frame_id, score, rank FROM frame_results) SELECT query_id, frame_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, rank NULLS LAST, frame_id) - 1 AS place FROM f")
def score_argsort(spark, directory) -> DataFrame:
    """TOPK-09: places by score, descending and stable over the recorded order."""
    f = table(spark, directory, "frame_results").select("query_id", "frame_id", "score", "rank").distinct()
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), F.col("rank").asc_nulls_last(), "frame_id")) - 1
    return f.select("query_id", "frame_id", place.cast("bigint").alias("place"))


@R.query("SELECT DISTINCT id FROM dev_gold WHERE question_type = 'negative' AND id IS NOT NULL ORDER BY id LIMIT 20")
def first_negatives(spark, directory) -> DataFrame:
    """TOPK-08: the first twenty negatives; the limit is the feature."""
    return table(spark, directory, "dev_gold").filter("question_type = 'negative' AND id IS NOT NULL").select("id").distinct().orderBy("id").limit(20)


@R.query(
    """WITH c AS (SELECT DISTINCT chunk_id, n, x FROM (SELECT chunk_id, unnest(range(len(frame_secs))) AS n, unnest(frame_secs) AS x FROM chunks WHERE chunk_id IS NOT NULL))
SELECT chunk_id, CAST(n AS INT) AS position, x AS sec, round(x - lag(x) OVER (PARTITION BY chunk_id ORDER BY n, x), 6) AS step FROM c"""
)
def array_flush(spark, directory) -> DataFrame:
    """SNK-15, TOPK-06, ARR-01: parallel arrays flushed as rows, ordered by parent and position."""
    c = table(spark, directory, "chunks").filter("chunk_id IS NOT NULL AND frame_secs IS NOT NULL AND size(frame_secs) > 0")
    zipped = F.arrays_zip(F.sequence(F.lit(0), F.size("frame_secs") - 1).alias("position"), F.col("frame_secs").alias("sec"))
    rows = c.select("chunk_id", F.inline(zipped).alias("position", "sec")).distinct()
    return rows.withColumn("step", F.round(F.col("sec") - F.lag("sec").over(W.partitionBy("chunk_id").orderBy("position", "sec")), 6))


@R.query("SELECT DISTINCT doc_id, strftime(fetched_at, '%Y-%m-%dT%H:%M:%SZ') AS iso, date_trunc('second', fetched_at) AS back FROM documents WHERE fetched_at IS NOT NULL")
def iso_times(spark, directory) -> DataFrame:
    """TIM-04: times written as ISO 8601 and read back."""
    d = table(spark, directory, "documents").filter("fetched_at IS NOT NULL").select("doc_id", F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso")).distinct()
    return d.select("doc_id", "iso", F.to_timestamp("iso", "yyyy-MM-dd'T'HH:mm:ssX").alias("back"))


@R.query(
    """WITH one AS (SELECT query_id, chunk_id, channel, min(rank) AS r FROM channel_results WHERE rank <= 30 AND channel <> 'visual' AND chunk_id IS NOT NULL GROUP BY ALL),
f AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + r)), 9) AS score FROM one GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f),
m AS (SELECT chunk_id, video_id, text FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY video_id, text) AS n FROM (SELECT chunk_id, video_id, text FROM chunks)) WHERE n = 1)
SELECT query_id, t.chunk_id, CAST(rank AS INT) AS rank, '[' || rank || '] [' || m.video_id || '] ' || m.text AS line FROM t JOIN m USING (chunk_id) WHERE rank <= 8"""
)
def generation_context(spark, directory) -> DataFrame:
    """CMP-06, PRJ-05: the eight first chunks of the four text channels as numbered lines of a prompt."""
    one = table(spark, directory, "channel_results").filter("rank <= 30 AND channel <> 'visual' AND chunk_id IS NOT NULL").groupBy("query_id", "chunk_id", "channel").agg(F.min("rank").alias("r"))
    fused = one.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (60 + F.col("r"))), 9).alias("score"))
    best = top_k(fused, ["query_id"], "score", "chunk_id", 8)
    meta = once(table(spark, directory, "chunks").select("chunk_id", "video_id", "text"), ["chunk_id"])
    return best.join(meta, "chunk_id").select("query_id", "chunk_id", "rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ["), "video_id", F.lit("] "), "text").alias("line"))


@R.query(
    """WITH c AS (SELECT DISTINCT video_id, chunking_strategy, start_sec, end_sec FROM chunks WHERE video_id IS NOT NULL AND chunking_strategy IS NOT NULL AND start_sec IS NOT NULL AND end_sec IS NOT NULL AND isfinite(start_sec) AND isfinite(end_sec))
SELECT row_number() OVER (ORDER BY video_id, chunking_strategy, start_sec, end_sec) - 1 AS position, video_id, substr(sha256(video_id || '|' || chunking_strategy || '|' || CAST(CAST(round(start_sec * 1000) AS BIGINT) AS VARCHAR) || '|' || CAST(CAST(round(end_sec * 1000) AS BIGINT) AS VARCHAR)), 1, 16) AS id FROM c"""
)
def natural_ids(spark, directory) -> DataFrame:
    """SNK-02, HSH-01: ids from the natural key of a chunk, given back in the order of the input.

    The order is a number given over ranges of the key: ranks inside a range and the sizes of the ranges before
    it, so no task sorts everything.
    """
    c = table(spark, directory, "chunks").filter("video_id IS NOT NULL AND chunking_strategy IS NOT NULL AND start_sec IS NOT NULL AND end_sec IS NOT NULL AND NOT isnan(start_sec) AND NOT isnan(end_sec) AND abs(start_sec) < 1e300 AND abs(end_sec) < 1e300")
    keys = ["video_id", "chunking_strategy", "start_sec", "end_sec"]
    rows = c.select(*keys).distinct()
    inside = rows.withColumn("r", F.row_number().over(W.partitionBy("video_id").orderBy(*keys[1:])))
    sizes = rows.groupBy("video_id").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("video_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ms = lambda x: F.round(F.col(x) * 1000).cast("bigint").cast("string")
    key = F.concat_ws("|", "video_id", "chunking_strategy", ms("start_sec"), ms("end_sec"))
    return inside.join(sizes.select("video_id", "before"), "video_id").select((F.col("r") + F.col("before") - 1).alias("position"), "video_id", F.substring(F.sha2(key, 256), 1, 16).alias("id"))


@R.query(
    """WITH v AS (SELECT frame_id, bool_or(pooled_embedding IS NOT NULL) AS had, bool_or(pooled_embedding IS NOT NULL AND len(pooled_embedding) = 32 AND len(list_filter(pooled_embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0) AS keeps FROM frame_samples WHERE frame_id IS NOT NULL GROUP BY frame_id)
SELECT frame_id, keeps, had AND NOT keeps AS cleared, CAST(CASE WHEN keeps THEN 4 ELSE 0 END AS INT) AS patches FROM v"""
)
def cleared_vectors(spark, directory) -> DataFrame:
    """SNK-07, SNK-08, SNK-09, FLT-13, VEC-07: vectors of a wrong dimension or with odd components are taken away with their patches."""
    f = table(spark, directory, "frame_samples").filter("frame_id IS NOT NULL")
    v = F.col("pooled_embedding")
    fine = F.coalesce(v.isNotNull() & (F.size(v) == 32) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 3.0e38)), F.lit(False))
    own = f.groupBy("frame_id").agg(F.bool_or(v.isNotNull()).alias("had"), F.bool_or(fine).alias("keeps"))
    return own.select("frame_id", "keeps", (F.col("had") & ~F.col("keeps")).alias("cleared"), F.when(F.col("keeps"), 4).otherwise(0).alias("patches"))
