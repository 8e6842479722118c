"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.functions.text import CONFUSABLES
from talkgrid.llm.leakage import leaked_passages
from talkgrid.llm.mixing import mix_to_targets
from talkgrid.llm.nearest import nearest_in_time
from talkgrid.llm.overlap import Overlaps, cross_split_overlaps
from talkgrid.llm.pairs import defective_pairs, trained_languages
from talkgrid.llm.pii import personal_details
from talkgrid.llm.ranking import net_flow, top_items
from talkgrid.llm.similar import nearest_vectors
from talkgrid.llm.splitting import count_tokens, split_oversized
from talkgrid.operators.intervals import valid_span
from talkgrid.plans.registry import Registry
from talkgrid.tables import once, table

R = Registry()

NEAREST_SEC = 8.0
MOMENT_SEC = 5.0


def _gold(spark, directory) -> DataFrame:
    """dev_gold with the split's spelling evened out and the moment of the first span."""
    gold = table(spark, directory, "dev_gold")
    split = F.lower(F.trim(F.col("split")))
    first = F.get(F.col("gold_spans"), 0)
    place = F.when(first.isNull(), F.struct(F.lit("none").alias("kind"), F.col("video_id").alias("v")))
    place = place.otherwise(F.struct(F.lit("span").alias("kind"), F.coalesce(first["video_id"], F.col("video_id")).alias("v")))
    out = gold.select("id", "question", "curator", split.alias("split"), F.when(split.isin("dev", "test"), True).when(split == "train", False).alias("is_eval"), place.alias("place"), first["start_sec"].alias("at"))
    return out.select("*", F.col("place.kind").alias("kind"), F.col("place.v").alias("v")).filter(~((F.col("kind") == "span") & F.col("at").isNull())).drop("place")


def _overlaps(spark, directory) -> Overlaps:
    return cross_split_overlaps(_gold(spark, directory), "id", "question", "is_eval", ["kind", "v"], "at", MOMENT_SEC)


@R.query()
def p1_found(spark, directory) -> DataFrame:
    """Pairs of an evaluation and a training record that ask the same about the same moment."""
    pairs = _overlaps(spark, directory).records()
    return pairs.select(F.least("e_id", "t_id").alias("id_a"), F.greatest("e_id", "t_id").alias("id_b")).filter("id_a < id_b").distinct()


@R.query()
def p1_report(spark, directory) -> DataFrame:
    """Per evaluation split and source: records, records that overlap, and overlapping pairs."""
    gold = _gold(spark, directory).filter("is_eval").select(F.col("id").alias("e_id"), "split", "curator").distinct()
    seen = gold.join(_overlaps(spark, directory).counts(), "e_id", "left")
    return seen.groupBy("split", F.col("curator").alias("source")).agg(
        F.countDistinct("e_id").alias("eval_records"), F.countDistinct(F.when(F.col("pairs") > 0, F.col("e_id"))).alias("overlapping_records"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")
    )


@R.query(
    """
WITH c AS (SELECT start_sec, video_id, min(chunk_id) AS chunk_id FROM chunks
           WHERE start_sec IS NOT NULL AND end_sec > start_sec AND isfinite(start_sec) AND isfinite(end_sec) AND video_id IS NOT NULL GROUP BY ALL),
f AS (SELECT DISTINCT frame_id, video_id, frame_sec FROM frame_samples WHERE frame_sec IS NOT NULL),
j AS (SELECT frame_id, chunk_id, row_number() OVER (PARTITION BY frame_id, f.video_id, frame_sec ORDER BY abs(frame_sec - start_sec), start_sec, chunk_id) AS rn
      FROM f JOIN c ON f.video_id = c.video_id AND start_sec BETWEEN frame_sec - 8.001 AND frame_sec + 8.001 AND abs(frame_sec - start_sec) <= 8)
SELECT DISTINCT frame_id, chunk_id FROM j WHERE rn = 1"""
)
def p7_found(spark, directory) -> DataFrame:
    """Each frame with the chunk of its video that starts nearest, at most 8 s away."""
    chunks = table(spark, directory, "chunks").filter(valid_span(F.col("start_sec"), F.col("end_sec")))
    frames = table(spark, directory, "frame_samples")
    near = nearest_in_time(frames, chunks, "frame_id", "video_id", "frame_sec", "chunk_id", "video_id", "start_sec", NEAREST_SEC)
    return near.select(F.col("left_id").alias("frame_id"), F.col("right_id").alias("chunk_id"))


TOP = 3
#: Lists looked into when no least similarity narrows the search: how much farther, and how many at most.
WIDE = {"margin": 0.5, "most": 48}

_LISTS_SQL = """
WITH l0 AS (
  SELECT query_id, channel, chunk_id, max(CASE WHEN isfinite(score) THEN score END) AS score, min(CASE WHEN rank > 0 THEN rank END) AS rank
  FROM channel_results WHERE query_id IS NOT NULL AND channel IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT query_id, '(rerank)', chunk_id, max(CASE WHEN isfinite(rerank_score) THEN rerank_score END), NULL
  FROM reranked_results WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL),
l1 AS (SELECT *, count(score) OVER (PARTITION BY query_id, channel ORDER BY score DESC NULLS LAST) AS n FROM l0 WHERE score IS NOT NULL OR rank IS NOT NULL),
l2 AS (SELECT query_id, channel, chunk_id, CAST(CASE WHEN score IS NULL THEN rank ELSE n END AS BIGINT) AS o FROM l1),
l3 AS (SELECT *, greatest(count(*) OVER (PARTITION BY query_id, channel), max(o) OVER (PARTITION BY query_id, channel)) AS m FROM l2),
l4 AS (SELECT query_id, channel, chunk_id, (2000000 * (m - o + 1) + m) // (2 * m) AS x FROM l3),
items AS (SELECT DISTINCT query_id, chunk_id FROM l4), lists AS (SELECT DISTINCT query_id, channel FROM l4),
g AS (SELECT i.query_id, i.chunk_id, l.channel, coalesce(x, 0) AS x FROM items i JOIN lists l USING (query_id) LEFT JOIN l4 USING (query_id, chunk_id, channel)),
d AS (SELECT a.query_id, a.chunk_id, sum(greatest(0, least(450000, a.x - b.x - 50000)) - greatest(0, least(450000, b.x - a.x - 50000))) AS d FROM g a JOIN g b USING (query_id, channel) GROUP BY ALL),
f AS (SELECT query_id, chunk_id, d / (450000.0 * greatest(count(*) OVER (PARTITION BY query_id) - 1, 1)) AS net FROM d)
"""


def _flows(spark, directory) -> DataFrame:
    channels = table(spark, directory, "channel_results").select("query_id", "channel", "chunk_id", "score", "rank")
    reranked = table(spark, directory, "reranked_results").select("query_id", F.lit("(rerank)").alias("channel"), "chunk_id", F.col("rerank_score").alias("score"), F.lit(None).cast("int").alias("rank"))
    return net_flow(channels.unionByName(reranked), "query_id", "channel", "chunk_id", "score", "rank")


@R.query(_LISTS_SQL + "SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(net, 9) DESC, chunk_id) AS p FROM f) WHERE p <= 3")
def p5_found(spark, directory) -> DataFrame:
    """The three first chunks of each query over all channels and the reranker."""
    return top_items(_flows(spark, directory), "query_id", "chunk_id", TOP).select("query_id", "chunk_id")


@R.query(_LISTS_SQL + "SELECT query_id, chunk_id, round(net + 1e-10, 6) + 0 AS net FROM f")
def p5_ranking(spark, directory) -> DataFrame:
    """Net flow of every candidate of every query."""
    return _flows(spark, directory).select("query_id", "chunk_id", (F.round(F.col("net") + 1e-10, 6) + 0).alias("net"))


_TOKENS_SQL = "len(regexp_extract_all(text, '[^ \\t\\r\\n]+'))"


def _pieces(spark, directory) -> DataFrame:
    return split_oversized(table(spark, directory, "chunks"), table(spark, directory, "chunk_limits"), "chunk_id", "chunking_strategy", "text", "max_tokens", "overlap_tokens")


@R.query(f"SELECT DISTINCT chunk_id FROM chunks JOIN chunk_limits USING (chunking_strategy) WHERE {_TOKENS_SQL} > max_tokens")
def p6_found(spark, directory) -> DataFrame:
    """Chunks that had to be cut."""
    return _pieces(spark, directory).filter("piece_no = 1").select("chunk_id").distinct()


@R.query()
def p6_pieces(spark, directory) -> DataFrame:
    """The pieces of all oversized chunks."""
    return _pieces(spark, directory)


def _leaks(spark, directory) -> DataFrame:
    return leaked_passages(table(spark, directory, "documents"), table(spark, directory, "held_out_items"), "doc_id", "text", "item_id", "text")


@R.query(f"SELECT DISTINCT chunk_id, CAST({_TOKENS_SQL} AS BIGINT) AS tokens, true AS covered, true AS within, true AS overlapping, true AS verbatim FROM chunks JOIN chunk_limits USING (chunking_strategy) WHERE {_TOKENS_SQL} > max_tokens")
def p6_checks(spark, directory) -> DataFrame:
    """Of every cut chunk: whether its pieces hold all its tokens once, keep the limit and the overlap, and stand in its text."""
    limits = table(spark, directory, "chunk_limits").select("chunking_strategy", "max_tokens", "overlap_tokens")
    texts = table(spark, directory, "chunks").filter("text IS NOT NULL").groupBy("chunk_id").agg(F.min("text").alias("whole"), F.min("chunking_strategy").alias("chunking_strategy"))
    pieces = _pieces(spark, directory).select("chunk_id", "piece_no", "first_token", F.col("overlap").alias("back"), "tokens", F.col("text").alias("piece"))
    rows = pieces.join(texts, "chunk_id").join(F.broadcast(limits), "chunking_strategy")
    return rows.groupBy("chunk_id").agg(
        F.sum(F.col("tokens") - F.col("back")).cast("bigint").alias("tokens"),
        (F.sum(F.col("tokens") - F.col("back")) == F.max(count_tokens(F.col("whole")))).alias("covered"),
        F.bool_and(F.col("tokens") <= F.col("max_tokens")).alias("within"),
        F.bool_and(F.col("back") == F.least(F.col("first_token"), F.col("overlap_tokens"))).alias("overlapping"),
        F.bool_and(F.contains("whole", "piece") & (count_tokens(F.col("piece")) == F.col("tokens"))).alias("verbatim"),
    )


def _passage_sql(x: str) -> str:
    """Words of a passage, as :func:`passage_words` reads them."""
    for entity, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
        x = f"replace({x}, '{entity}', '{sign}')"
    x = f"regexp_replace({x}, '</?[A-Za-z][^<>]*>|<!--(?s:.*?)-->', ' ', 'g')"
    x = f"regexp_replace({x}, '\\]\\([^()\\s]+\\)', '] ', 'g')"
    x = f"regexp_replace({x}, '(?m)^\\s*\\d+\\s*\\r?\\n(\\s*\\d{{1,2}}:\\d{{2}})', ' \\1', 'g')"
    x = f"regexp_replace({x}, '[\\[(<]?\\b\\d{{1,2}}:\\d{{2}}(:\\d{{2}})?([.,]\\d{{1,3}})?\\b[\\])>]?|-->', ' ', 'g')"
    x = f"lower(nfc_normalize(regexp_replace({x}, '[\\x{{ad}}\\x{{200b}}-\\x{{200f}}\\x{{2060}}\\x{{feff}}]', '', 'g')))"
    x = f"translate({x}, '{''.join(CONFUSABLES)}', '{''.join(CONFUSABLES.values())}')"
    x = f"regexp_replace({x}, '([\\p{{L}}\\p{{N}}])[''’]s\\b', '\\1', 'g')"
    return f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+')"


_LEAKS_SQL = f"""WITH d AS (SELECT DISTINCT doc_id, {_passage_sql("text")} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
i AS (SELECT DISTINCT item_id, {_passage_sql("text")} AS w FROM held_out_items WHERE text IS NOT NULL AND item_id IS NOT NULL),
gd AS (SELECT doc_id, k AS kd, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
gi AS (SELECT item_id, k AS ki, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
m AS (SELECT DISTINCT doc_id, item_id, kd, kd - ki AS diagonal FROM gd JOIN gi USING (g)),
r AS (SELECT *, kd - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY kd) AS island FROM m),
l AS (SELECT doc_id, item_id, count(*) + 11 AS words FROM r GROUP BY doc_id, item_id, diagonal, island),
leaks AS (SELECT doc_id, item_id, CAST(max(words) AS INT) AS words FROM l GROUP BY ALL)
"""


@R.query(_LEAKS_SQL + "SELECT doc_id, item_id FROM leaks")
def p8_found(spark, directory) -> DataFrame:
    """Documents that repeat at least 12 consecutive words of a held-out item."""
    return _leaks(spark, directory).select("doc_id", "item_id")


@R.query(
    _LEAKS_SQL
    + """, p AS (SELECT item_id, count(*) AS documents, max(words) AS longest FROM leaks GROUP BY item_id)
SELECT DISTINCT item_id, test_set, coalesce(documents, 0) AS documents, coalesce(longest, 0) AS longest FROM held_out_items LEFT JOIN p USING (item_id)"""
)
def p8_report(spark, directory) -> DataFrame:
    """Per held-out item: the documents that repeat it and the longest run repeated."""
    items = table(spark, directory, "held_out_items").select("item_id", "test_set").distinct()
    leaks = _leaks(spark, directory).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest"))
    return items.join(leaks, "item_id", "left").select("item_id", "test_set", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("longest", F.lit(0)).alias("longest"))


def _near_sql(source: str, key: str, vec: str, asked: str, least: str) -> str:
    """Brute force: the five most similar others of every vector asked for."""
    finite = f"{vec} IS NOT NULL AND len({vec}) > 0 AND len(list_filter({vec}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({vec}, lambda x: x <> 0)) > 0"
    return f"""WITH v AS (SELECT DISTINCT {key} AS id, CAST({vec} AS DOUBLE[]) AS vec FROM {source} WHERE {key} IS NOT NULL AND {finite}),
s AS (SELECT a.id, b.id AS neighbour, max(round(list_cosine_similarity(a.vec, b.vec), 7)) AS sim FROM v a JOIN v b ON a.id <> b.id AND len(a.vec) = len(b.vec) WHERE {asked} GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, neighbour) AS r FROM s WHERE {least})
"""


@R.query(_near_sql("dense_embeds", "chunk_id", "dense", "true", "sim >= 0.86") + "SELECT DISTINCT least(id, neighbour) AS chunk_a, greatest(id, neighbour) AS chunk_b FROM t WHERE r <= 5")
def p3_found(spark, directory) -> DataFrame:
    """Pairs of chunks with a cosine of at least 0.86, one among the other's five most similar."""
    near = nearest_vectors(table(spark, directory, "dense_embeds"), "chunk_id", "dense", 5, 0.86)
    return near.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()


@R.query(_near_sql("dense_embeds", "chunk_id", "dense", "a.id % 50 = 0", "true") + "SELECT id AS chunk_id, neighbour, round(sim + 1e-9, 5) AS sim FROM t WHERE r <= 5")
def p3_neighbours(spark, directory) -> DataFrame:
    """The five most similar chunks, whatever the similarity, of every chunk whose id is divisible by 50."""
    near = nearest_vectors(table(spark, directory, "dense_embeds"), "chunk_id", "dense", 5, ask=F.col("chunk_id") % 50 == 0, **WIDE)
    return near.select(F.col("id").alias("chunk_id"), "neighbour", F.round(F.col("sim") + 1e-9, 5).alias("sim"))


@R.query(_near_sql("frame_samples", "frame_id", "pooled_embedding", "a.id % 50 = 0", "true") + "SELECT id AS frame_id, neighbour, round(sim + 1e-9, 5) AS sim FROM t WHERE r <= 5")
def p3_frames(spark, directory) -> DataFrame:
    """The same over the pooled vectors of frames whose id is divisible by 50."""
    near = nearest_vectors(table(spark, directory, "frame_samples"), "frame_id", "pooled_embedding", 5, ask=F.col("frame_id") % 50 == 0, **WIDE)
    return near.select(F.col("id").alias("frame_id"), "neighbour", F.round(F.col("sim") + 1e-9, 5).alias("sim"))


def _defects(spark, directory) -> DataFrame:
    answers = once(table(spark, directory, "per_example").select("run_id", "example_id", "answer", "abstain", "parse_ok", "raw_response"), ["run_id", "example_id"])
    gold = once(table(spark, directory, "dev_gold").select("id", "question", "question_type"), ["id"])
    asked = gold.filter(F.coalesce(F.col("question_type"), F.lit("")) != "negative").select(F.col("id").alias("example_id"), "question")
    return defective_pairs(answers.join(asked, "example_id"), ["run_id", "example_id"], "question", "answer", "abstain", "parse_ok", "raw_response", languages=trained_languages(table(spark, directory, "documents"), "doc_id", "lang", "text"))


@R.query()
def p4_found(spark, directory) -> DataFrame:
    """Answers that do not serve their question, with the kind of defect."""
    return _defects(spark, directory).select("run_id", "example_id", "defect")


@R.query()
def p4_report(spark, directory) -> DataFrame:
    """Per run and defect: the number of answers."""
    return _defects(spark, directory).groupBy("run_id", "defect").agg(F.count("*").alias("answers"))


def _details(spark, directory) -> DataFrame:
    return personal_details(table(spark, directory, "documents"), "doc_id", "text", table(spark, directory, "given_names"))


@R.query()
def p10_found(spark, directory) -> DataFrame:
    """Personal details, one row per distinct value of a document."""
    return _details(spark, directory).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.pii_type", "f.value").distinct()


@R.query()
def p10_redacted(spark, directory) -> DataFrame:
    """Every document with its details replaced by placeholders."""
    return _details(spark, directory).select("doc_id", F.col("redacted").alias("text"), F.size("found").alias("details"))


@R.query("SELECT DISTINCT doc_id, CAST(length(text) AS BIGINT) AS chars, true AS rest_kept FROM documents WHERE text IS NOT NULL")
def p10_checks(spark, directory) -> DataFrame:
    """Of every document: its length, and whether nothing but the details was replaced."""
    rows = _details(spark, directory).filter("redacted IS NOT NULL").withColumn("values", F.transform("found", lambda f: f["value"]))
    marks = r"\[(?:EMAIL|PHONE|ID_NUMBER|ADDRESS|NAME)\]"
    original = table(spark, directory, "documents").select("doc_id", F.col("text").alias("whole")).filter("whole IS NOT NULL").distinct()
    rest = F.split("redacted", marks)
    ends = F.startswith(F.col("whole"), rest[0]) & F.endswith(F.col("whole"), F.element_at(rest, -1))
    held = F.forall(rest, lambda part: F.contains(F.col("whole"), part))
    gone = F.length(F.array_join("values", "")) + F.length(F.array_join(rest, ""))
    return original.join(rows, "doc_id").select("doc_id", F.length("whole").cast("bigint").alias("chars"), (ends & held & (gone == F.length("whole"))).alias("rest_kept")).distinct()


def _mix(spark, directory):
    return mix_to_targets(table(spark, directory, "documents"), table(spark, directory, "source_targets"), "doc_id", "text", "source", "target_share", "max_repeats")


@R.query()
def p9_report(spark, directory) -> DataFrame:
    """Per target source: its target, what it can give, what it gives and the share reached."""
    return _mix(spark, directory).report


@R.query()
def p9_copies(spark, directory) -> DataFrame:
    """How many times every document is taken."""
    return _mix(spark, directory).documents


@R.query(
    """WITH t AS (SELECT source, target_share, max_repeats FROM source_targets WHERE source IS NOT NULL),
d AS (SELECT source, count(DISTINCT text) AS texts FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY source)
SELECT t.source, coalesce(texts, 0) AS texts, CAST(0 AS BIGINT) AS over_cap, CAST(0 AS BIGINT) AS repeated_twice FROM t LEFT JOIN d USING (source)"""
)
def p9_checks(spark, directory) -> DataFrame:
    """Of every target source: its texts, those taken more often than allowed, and those taken under several ids."""
    docs = table(spark, directory, "documents").filter("text IS NOT NULL AND text <> ''").select("doc_id", "source", F.xxhash64("text").alias("h"))
    goal = table(spark, directory, "source_targets").select("source", "max_repeats")
    mix = _mix(spark, directory)
    taken = docs.join(mix.documents, "doc_id")
    per = taken.groupBy("h").agg(F.sum("copies").alias("copies"), F.count(F.when(F.col("copies") > 0, 1)).alias("ids"))
    facts = taken.select("source", "h").distinct().join(per, "h").join(F.broadcast(goal), "source").groupBy("source").agg(
        F.count("*").alias("texts"), F.count(F.when((F.col("copies") > F.col("max_repeats")) & (F.col("ids") == 1), 1)).alias("over"), F.count(F.when(F.col("ids") > 1, 1)).alias("twice")
    )
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return goal.select("source").filter("source IS NOT NULL").join(facts, "source", "left").select("source", zero("texts", "texts"), zero("over", "over_cap"), zero("twice", "repeated_twice"))


def queries() -> dict:
    """Name -> callable."""
    return dict(R.queries)


def oracle_sql() -> dict[str, str]:
    """Name -> SQL."""
    return dict(R.sql)
