"""Ranked retrieval over chunks and frames for whole batches of queries, fusion and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.functions.columns import stop_sql, terms
from talkgrid.operators import fusion, search
from talkgrid.operators.intervals import bin_range_join, valid_span
from talkgrid.operators.vectors import exact_search, finite_vector, late_interaction, mean_pool, top_k
from talkgrid.plans.registry import Registry
from talkgrid.tables import once, small, table

R = Registry()
TOP, PREFILTER, FRAME_PREFILTER = 30, 100, 200

_FINITE = "{v} IS NOT NULL AND len(list_filter({v}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0"
_VEC_SQL = f"""
v AS (SELECT chunk_id, CAST(min(dense) AS DOUBLE[]) AS vec FROM dense_embeds WHERE chunk_id IS NOT NULL AND {_FINITE.format(v="dense")} GROUP BY chunk_id),
fw AS (SELECT DISTINCT chunk_id FROM chunks WHERE chunking_strategy = 'fixed_window'),
d0 AS (SELECT q.chunk_id AS query_id, r.chunk_id, round(list_cosine_similarity(q.vec, r.vec), 6) AS score
       FROM v q, v r SEMI JOIN fw USING (chunk_id) WHERE q.chunk_id % 50 = 0),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM d0)
"""
_TERMS = f"list_distinct(list_filter(regexp_extract_all(lower({{t}}), '[a-z0-9]+'), lambda x: length(x) >= 3 AND NOT list_contains({stop_sql()}, x)))"
_TERM_LIST = f"list_filter(regexp_extract_all(lower({{t}}), '[a-z0-9]+'), lambda x: length(x) >= 3 AND NOT list_contains({stop_sql()}, x))"
_POST_SQL = f"""
t0 AS (SELECT chunk_id AS id, {_TERM_LIST.format(t="text")} AS t FROM (SELECT chunk_id, min(text) AS text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY chunk_id)),
t1 AS (SELECT * FROM t0 WHERE len(t) > 0),
post AS (SELECT id, term, count(*) AS tf, any_value(n) AS length FROM (SELECT id, len(t) AS n, unnest(t) AS term FROM t1) GROUP BY id, term),
"""
_MATCH_SQL = (
    _POST_SQL
    + """
q AS (SELECT DISTINCT qid, len(t) AS wanted, unnest(t) AS term FROM (SELECT {qid} AS qid, {terms} AS t FROM {source})),
sz AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t1),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
m AS (SELECT qid, id, wanted, count(*) AS hits, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
      FROM q JOIN df USING (term) JOIN post USING (term), sz GROUP BY qid, id, wanted)
"""
)


def _chunks(spark, directory) -> DataFrame:
    """Chunks counted once."""
    return once(table(spark, directory, "chunks").select("chunk_id", "video_id", "chunking_strategy", "start_sec", "end_sec", "text"), ["chunk_id"])


def _vectors(spark, directory) -> DataFrame:
    return table(spark, directory, "dense_embeds").select(F.col("chunk_id").alias("id"), F.col("dense").alias("vec"))


def _dense(spark, directory, k: int) -> DataFrame:
    vecs = _vectors(spark, directory)
    fixed = table(spark, directory, "chunks").filter("chunking_strategy = 'fixed_window'").select(F.col("chunk_id").alias("id")).distinct()
    found = exact_search(vecs.filter("id % 50 = 0").withColumnRenamed("id", "qid"), vecs.join(fixed, "id", "left_semi"), k)
    return found.select(F.col("qid").alias("query_id"), F.col("id").alias("chunk_id"), "score", "rank")


@R.query(f"WITH {_VEC_SQL} SELECT query_id, chunk_id, score, rank FROM d WHERE rank <= 30")
def dense_topk(spark, directory) -> DataFrame:
    """JOIN-01, JOIN-11, VEC-01, FLT-01, TOPK-01: exact cosine neighbours among fixed windows."""
    return _dense(spark, directory, TOP)


def _terms(spark, directory) -> DataFrame:
    return search.term_rows(table(spark, directory, "chunks"), "chunk_id", "text")


def _asked(spark, directory) -> DataFrame:
    """What is asked: the questions, and the titles of their talks."""
    gold = table(spark, directory, "dev_gold")
    asked = F.explode(F.array("question", F.regexp_replace("talk_title", " in practice$", "")))
    return gold.select(asked.alias("query")).filter("query IS NOT NULL").distinct().withColumn("text", F.col("query"))


_TITLES_SQL = "WITH " + _MATCH_SQL.format(
    qid="subject", terms=_TERMS.format(t="subject"), source="(SELECT question AS subject FROM dev_gold WHERE question IS NOT NULL UNION SELECT regexp_replace(talk_title, ' in practice$', '') FROM dev_gold WHERE talk_title IS NOT NULL)"
)


@R.query(_TITLES_SQL + "SELECT qid AS query, id AS chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM m WHERE hits = wanted) WHERE rank <= 30")
def fts_all_terms(spark, directory) -> DataFrame:
    """FLT-02, STR-08, STR-10: chunks that hold every term of a question or title, by Okapi BM25."""
    return search.search_all_terms(search.bm25(_asked(spark, directory), "query", "text", _terms(spark, directory), TOP), TOP).select(F.col("qid").alias("query"), F.col("id").alias("chunk_id"), "score", "rank")


@R.query(
    _TITLES_SQL
    + """, f AS (SELECT * FROM m WHERE hits = wanted UNION ALL SELECT * FROM m WHERE qid NOT IN (SELECT qid FROM m WHERE hits = wanted))
SELECT qid AS query, id AS chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 30"""
)
def fts_or_fallback(spark, directory) -> DataFrame:
    """FLT-03: the same, with any-term matches where there is no all-term match."""
    return search.search_or_fallback(search.bm25(_asked(spark, directory), "query", "text", _terms(spark, directory), TOP), TOP).select(F.col("qid").alias("query"), F.col("id").alias("chunk_id"), "score", "rank")


@R.query(
    "WITH "
    + _POST_SQL
    + f"""
q0 AS (SELECT item_id, {_TERM_LIST.format(t="text")} AS t FROM held_out_items),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(t) AS term FROM q0) GROUP BY ALL),
s AS (SELECT item_id, id AS chunk_id, CAST(sum(qtf * tf) AS DOUBLE) AS score FROM q JOIN post USING (term) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 30"""
)
def sparse_topk(spark, directory) -> DataFrame:
    """JOIN-02, VEC-02, VEC-06: sparse inner products of held-out items with chunks."""
    found = search.sparse_search(table(spark, directory, "held_out_items"), "item_id", "text", _terms(spark, directory), TOP)
    return found.select(F.col("qid").alias("item_id"), F.col("id").alias("chunk_id"), "score", "rank")


@R.query()
def fts_websearch(spark, directory) -> DataFrame:
    """STR-09: titles as web search queries over stemmed words: the title as a phrase, or its words without those of its reverse."""
    title = F.regexp_replace("talk_title", " in practice$", "")
    q = table(spark, directory, "dev_gold").filter("talk_title IS NOT NULL").select(title.alias("title")).distinct()
    text = F.concat(F.lit('"'), "title", F.lit('" OR '), "title", F.lit(' -captions'))
    found = search.websearch(q.select("title", text.alias("text")), "title", "text", table(spark, directory, "chunks"), "chunk_id", "text", TOP)
    return found.select(F.col("qid").alias("title"), F.col("id").alias("chunk_id"), "score", "rank")


@R.query(f"SELECT id, CASE WHEN len(t) = 0 THEN NULL ELSE array_to_string(list_sort(t), ' | ') END AS expansion FROM (SELECT DISTINCT id, {_TERMS.format(t='question')} AS t FROM dev_gold WHERE question IS NOT NULL)")
def query_expand_terms(spark, directory) -> DataFrame:
    """STR-08, FLT-18, SET-05: distinct search terms of every question."""
    gold = table(spark, directory, "dev_gold").filter("question IS NOT NULL").select("id", terms(F.col("question")).alias("t")).distinct()
    return gold.select("id", F.when(F.size("t") > 0, F.array_join(F.array_sort("t"), " | ")).alias("expansion")).distinct()


def _sparse(spark, directory, k: int) -> DataFrame:
    """Fixed windows of the largest inner product of terms with the chunk that asks."""
    chunks = table(spark, directory, "chunks")
    fixed = chunks.filter("chunking_strategy = 'fixed_window'").select(F.col("chunk_id").alias("id")).distinct()
    asks = chunks.filter("chunk_id % 50 = 0 AND text IS NOT NULL").groupBy("chunk_id").agg(F.min("text").alias("text"))
    found = search.sparse_search(asks, "chunk_id", "text", _terms(spark, directory).join(fixed, "id", "left_semi"), k)
    return found.select(F.col("qid").alias("query_id"), F.col("id").alias("chunk_id"))


@R.query(
    f"WITH {_POST_SQL.strip()} {_VEC_SQL}"
    + """, dots AS (SELECT a.id AS query_id, b.id AS chunk_id, sum(a.tf * b.tf) AS dot FROM post a JOIN post b USING (term) WHERE a.id % 50 = 0 AND b.id IN (SELECT chunk_id FROM fw) GROUP BY ALL),
sp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, chunk_id) AS rank FROM dots),
cand AS (SELECT query_id, chunk_id FROM d WHERE rank <= 100 UNION SELECT query_id, chunk_id FROM sp WHERE rank <= 100),
tk AS (SELECT chunk_id, unnest(range(4)) AS n, vec FROM v),
p AS (SELECT c.query_id, c.chunk_id, q.n AS i, list_inner_product(q.vec[16 * q.n + 1 : 16 * q.n + 16], r.vec[16 * r.n + 1 : 16 * r.n + 16]) AS dot FROM cand c JOIN tk q ON c.query_id = q.chunk_id JOIN tk r ON c.chunk_id = r.chunk_id),
e AS (SELECT query_id, chunk_id, i, max(dot) AS best FROM p GROUP BY ALL),
s AS (SELECT query_id, chunk_id, round(sum(best), 6) AS score FROM e GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 30"""
)
def maxsim_multivec(spark, directory) -> DataFrame:
    """SET-01, JOIN-12, AGG-04, TOPK-03, VEC-03: late interaction over the 100 nearest chunks by vector and the 100 by terms.

    The tables hold no token vectors; four slices of the dense vector are the tokens, as rows of a token table.
    """
    vecs = _vectors(spark, directory).filter(finite_vector(F.col("vec")) & (F.size("vec") == 64)).groupBy("id").agg(F.min("vec").alias("vec"))
    tokens = vecs.select("id", F.posexplode(F.array(*[F.slice("vec", 16 * i + 1, 16) for i in range(4)])).alias("position", "vec"))
    cand = _dense(spark, directory, PREFILTER).select("query_id", "chunk_id").unionByName(_sparse(spark, directory, PREFILTER)).distinct()
    found = late_interaction(cand.select(F.col("query_id").alias("qid"), F.col("chunk_id").alias("id")), tokens.filter("id % 50 = 0").withColumnRenamed("id", "qid"), tokens)
    return top_k(found.select(F.col("qid").alias("query_id"), F.col("id").alias("chunk_id"), "score"), ["query_id"], "score", "chunk_id", TOP)


_FRAME_SQL = f"""
fv AS (SELECT frame_id, CAST(min(pooled_embedding) AS DOUBLE[]) AS vec FROM frame_samples WHERE frame_id IS NOT NULL AND {_FINITE.format(v="pooled_embedding")} GROUP BY frame_id),
f0 AS (SELECT q.frame_id AS query_id, r.frame_id, round(list_cosine_similarity(q.vec, r.vec), 6) AS score FROM fv q, fv r WHERE q.frame_id % 50 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, frame_id) AS rank FROM f0)
"""


def _frames(spark, directory, k: int) -> DataFrame:
    vecs = table(spark, directory, "frame_samples").select(F.col("frame_id").alias("id"), F.col("pooled_embedding").alias("vec"))
    found = exact_search(vecs.filter("id % 50 = 0").withColumnRenamed("id", "qid"), vecs, k)
    return found.select(F.col("qid").alias("query_id"), F.col("id").alias("frame_id"), "score", "rank")


@R.query(f"WITH {_FRAME_SQL} SELECT query_id, frame_id, score, rank FROM f WHERE rank <= 30")
def visual_frames_topk(spark, directory) -> DataFrame:
    """FLT-04, VEC-01: nearest frames by pooled vector."""
    return _frames(spark, directory, TOP)


_SPANS_SQL = """
c AS (SELECT DISTINCT chunk_id, video_id, chunking_strategy, start_sec, end_sec FROM chunks WHERE chunk_id IS NOT NULL AND video_id IS NOT NULL AND end_sec > start_sec AND isfinite(start_sec) AND isfinite(end_sec)),
fs AS (SELECT DISTINCT frame_id, video_id, frame_sec FROM frame_samples WHERE frame_id IS NOT NULL AND frame_sec IS NOT NULL)
"""


def _spans(spark, directory) -> DataFrame:
    chunks = table(spark, directory, "chunks").filter(valid_span(F.col("start_sec"), F.col("end_sec")) & F.col("chunk_id").isNotNull())
    return chunks.select("chunk_id", "video_id", "chunking_strategy", "start_sec", "end_sec").distinct()


def _frame_times(spark, directory) -> DataFrame:
    return table(spark, directory, "frame_samples").filter("frame_id IS NOT NULL AND frame_sec IS NOT NULL").select("frame_id", "video_id", "frame_sec").distinct()


@R.query(f"WITH {_SPANS_SQL} SELECT frame_id, chunk_id FROM fs JOIN c ON fs.video_id = c.video_id AND frame_sec >= start_sec AND frame_sec < end_sec")
def frames_in_chunks(spark, directory) -> DataFrame:
    """JOIN-03, FLT-06: frames and the half-open chunk intervals that hold them."""
    frames = _frame_times(spark, directory).withColumnRenamed("video_id", "f_video").withColumn("video_id", F.col("f_video")).drop("f_video")
    return bin_range_join(frames, _spans(spark, directory), "video_id", "frame_sec", "start_sec", "end_sec").select("frame_id", "chunk_id")


@R.query(f"WITH {_SPANS_SQL} SELECT chunk_id, count(frame_id) AS frames, min(frame_sec) AS first_sec, max(frame_sec) AS last_sec FROM c LEFT JOIN fs ON fs.video_id = c.video_id AND frame_sec >= start_sec AND frame_sec < end_sec GROUP BY chunk_id")
def frames_per_chunk(spark, directory) -> DataFrame:
    """JOIN-09, AGG-25: number of frames in each chunk and their range."""
    spans = _spans(spark, directory)
    held = bin_range_join(_frame_times(spark, directory), spans, "video_id", "frame_sec", "start_sec", "end_sec").groupBy("chunk_id").agg(F.count("*").alias("frames"), F.min("frame_sec").alias("first_sec"), F.max("frame_sec").alias("last_sec"))
    return spans.select("chunk_id").distinct().join(held, "chunk_id", "left").select("chunk_id", F.coalesce("frames", F.lit(0)).alias("frames"), "first_sec", "last_sec")


@R.query(
    f"WITH {_FRAME_SQL}, {_SPANS_SQL}"
    + """, hit AS (SELECT DISTINCT query_id, chunk_id, fs.frame_id FROM f JOIN fs ON f.frame_id = fs.frame_id JOIN c ON fs.video_id = c.video_id AND frame_sec >= start_sec AND frame_sec < end_sec WHERE rank <= 200),
e AS (SELECT query_id, chunk_id, i, max(list_inner_product(q.vec[8 * i + 1 : 8 * i + 8], r.vec[8 * j + 1 : 8 * j + 8])) AS best
      FROM hit JOIN fv q ON hit.query_id = q.frame_id JOIN fv r ON hit.frame_id = r.frame_id, range(4) x(i), range(4) y(j) GROUP BY ALL),
s AS (SELECT query_id, chunk_id, round(sum(best), 6) AS score FROM e GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 30"""
)
def visual_chunks_maxsim(spark, directory) -> DataFrame:
    """JOIN-03, AGG-25, AGG-04: chunks by late interaction with the patches of their prefiltered frames."""
    near = _frames(spark, directory, FRAME_PREFILTER).select("query_id", "frame_id")
    placed = near.join(_frame_times(spark, directory), "frame_id")
    hit = bin_range_join(placed, _spans(spark, directory), "video_id", "frame_sec", "start_sec", "end_sec").select("query_id", "chunk_id", "frame_id").distinct()
    vecs = table(spark, directory, "frame_samples").filter(finite_vector(F.col("pooled_embedding")) & (F.size("pooled_embedding") == 32)).groupBy("frame_id").agg(F.min("pooled_embedding").alias("vec"))
    patches = vecs.select("frame_id", F.posexplode(F.array(*[F.slice("vec", 8 * i + 1, 8) for i in range(4)])).alias("position", "vec"))
    # a chunk's patches are those of all its hit frames
    found = late_interaction(hit.select(F.col("query_id").alias("qid"), F.col("chunk_id").alias("id"), F.col("frame_id").alias("part")), patches.filter("frame_id % 50 = 0").withColumnRenamed("frame_id", "qid"), patches.withColumnRenamed("frame_id", "id"), by_part=True)
    return top_k(found.select(F.col("qid").alias("query_id"), F.col("id").alias("chunk_id"), "score"), ["query_id"], "score", "chunk_id", TOP)


@R.query(
    """WITH v AS (SELECT frame_id, any_value(video_id) AS video_id, min(pooled_embedding) AS vec FROM frame_samples WHERE pooled_embedding IS NOT NULL GROUP BY frame_id),
e AS (SELECT video_id, unnest(range(32)) AS pos, unnest(CAST(vec AS DOUBLE[])) AS x FROM v WHERE len(vec) = 32),
m AS (SELECT video_id, pos, avg(x) AS x FROM e GROUP BY ALL)
SELECT video_id, round(sqrt(sum(x * x)), 6) AS norm, count(*) AS dims FROM m GROUP BY video_id"""
)
def video_mean_pool(spark, directory) -> DataFrame:
    """AGG-05: mean pooled vector of each video, shown by its length."""
    v = table(spark, directory, "frame_samples").filter("pooled_embedding IS NOT NULL").groupBy("frame_id").agg(F.first("video_id").alias("video_id"), F.min("pooled_embedding").alias("vec")).filter("size(vec) = 32")
    pooled = mean_pool(v, "video_id", "vec", 32)
    return pooled.select("video_id", F.round(F.sqrt(F.aggregate("pooled", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"), F.size("pooled").cast("bigint").alias("dims"))


# --- fusion ------------------------------------------------------------------------------------
_RRF_SQL = """
WITH one AS (SELECT query_id, chunk_id, channel, min(rank) AS r FROM channel_results WHERE rank IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL),
f AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + r)), 9) AS score, count(*) AS channels, min(r) AS best_rank FROM one GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f)
"""


@R.query(
    _RRF_SQL
    + """, meta AS (SELECT chunk_id, video_id, start_sec, end_sec FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY video_id, chunking_strategy, start_sec, end_sec, text) AS n FROM chunks) WHERE n = 1)
SELECT t.query_id, t.chunk_id, score, rank, channels, best_rank, m.video_id, m.start_sec, m.end_sec FROM t LEFT JOIN meta m USING (chunk_id) WHERE rank <= 8"""
)
def rrf_fuse(spark, directory) -> DataFrame:
    """AGG-01, AGG-02, AGG-03, WIN-02, JOIN-04, SET-02: reciprocal-rank fusion of the five channels, hydrated with chunk metadata."""
    fused = fusion.reciprocal_rank_fusion(table(spark, directory, "channel_results"), "query_id", "chunk_id", "channel", "rank")
    meta = _chunks(spark, directory).select("chunk_id", "video_id", "start_sec", "end_sec")
    best = F.array_min(F.map_values("channel_ranks"))
    return fused.select("query_id", "chunk_id", "score", "rank", F.size("channel_ranks").cast("bigint").alias("channels"), best.alias("best_rank")).join(meta, "chunk_id", "left")


@R.query(_RRF_SQL + "SELECT query_id, t.chunk_id, channel, r AS channel_rank FROM t JOIN one USING (query_id, chunk_id) WHERE rank <= 8")
def rrf_channel_ranks(spark, directory) -> DataFrame:
    """AGG-02, MAP-01: which channel gave a fused chunk which rank."""
    fused = fusion.reciprocal_rank_fusion(table(spark, directory, "channel_results"), "query_id", "chunk_id", "channel", "rank")
    return fused.select("query_id", "chunk_id", F.explode("channel_ranks").alias("channel", "channel_rank"))


@R.query(
    """WITH r AS (SELECT query_id, chunk_id, max(rerank_score) AS s FROM reranked_results WHERE rerank_score IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL),
x AS (SELECT query_id, chunk_id, round(1 / (1 + exp(-s)), 9) AS probability FROM r)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY probability DESC, chunk_id) AS rank FROM x) WHERE rank <= 8"""
)
def rerank_topk(spark, directory) -> DataFrame:
    """VEC-05, WIN-03: reranked chunks by the sigmoid of their score."""
    r = table(spark, directory, "reranked_results").filter("rerank_score IS NOT NULL AND chunk_id IS NOT NULL").groupBy("query_id", "chunk_id").agg(F.max("rerank_score").alias("s"))
    return top_k(r.select("query_id", "chunk_id", F.round(fusion.sigmoid(F.col("s")), 9).alias("probability")), ["query_id"], "probability", "chunk_id", 8)


@R.query(
    """SELECT query_id, CAST(count(DISTINCT chunk_id) AS BIGINT) AS candidates, CAST(count(DISTINCT CASE WHEN channel = 'dense' THEN chunk_id END) AS BIGINT) AS dense, CAST(count(DISTINCT CASE WHEN channel = 'sparse' THEN chunk_id END) AS BIGINT) AS sparse
FROM channel_results WHERE channel IN ('dense', 'sparse') GROUP BY query_id"""
)
def candidate_union(spark, directory) -> DataFrame:
    """SET-01: candidates of the dense and sparse channels together."""
    rows = table(spark, directory, "channel_results").filter(F.col("channel").isin("dense", "sparse"))
    per = rows.groupBy("query_id", "chunk_id").agg(F.max((F.col("channel") == "dense").cast("int")).alias("d"), F.max((F.col("channel") == "sparse").cast("int")).alias("s"))
    return per.groupBy("query_id").agg(F.count("chunk_id").alias("candidates"), F.count(F.when((F.col("d") == 1) & F.col("chunk_id").isNotNull(), 1)).alias("dense"), F.count(F.when((F.col("s") == 1) & F.col("chunk_id").isNotNull(), 1)).alias("sparse"))


@R.query(
    """WITH want AS (SELECT DISTINCT query_id FROM channel_results), have AS (SELECT DISTINCT query_id FROM reranked_results)
SELECT query_id FROM want ANTI JOIN have USING (query_id)"""
)
def never_reranked(spark, directory) -> DataFrame:
    """JOIN-18, SET-04, CMP-09: queries of the channels that the reranker never saw."""
    want = table(spark, directory, "channel_results").select("query_id").distinct()
    return want.join(small(table(spark, directory, "reranked_results").select("query_id").distinct()), "query_id", "left_anti")


@R.query(
    """WITH one AS (SELECT query_id, chunk_id, max(rank) AS r, any_value(CAST(channel_ranks AS VARCHAR)) AS cr, max(rrf_score) AS rrf, max(score) AS sc FROM reranked_results GROUP BY ALL)
SELECT query_id, chunk_id, coalesce(rrf, sc) AS score, r AS rank FROM one"""
)
def fused_from_reranked(spark, directory) -> DataFrame:
    """PRJ-03: reranked rows read back as fused rows, score from the fusion where it is known."""
    rows = table(spark, directory, "reranked_results").groupBy("query_id", "chunk_id").agg(F.max("rank").alias("r"), F.max("rrf_score").alias("rrf"), F.max("score").alias("sc"))
    return rows.select("query_id", "chunk_id", F.coalesce("rrf", "sc").alias("score"), F.col("r").alias("rank"))
