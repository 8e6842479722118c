"""Queries from caption texts to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.functions.columns import ENTITIES, clean_line, seconds_clock, token_count
from talkgrid.operators import captions
from talkgrid.plans.registry import Registry
from talkgrid.tables import table

R = Registry()

_HEADER_RX = "^(" + "|".join(captions.HEADERS) + ")"


def _line_sql(x: str) -> str:
    """A line without tags, common entities, speaker marks and repeated white space."""
    x = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for entity, sign in ENTITIES:
        x = f"replace({x}, '{entity}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace(regexp_replace({x}, '^>>\\s*', ''), '[\\s\\x{{a0}}]+', ' ', 'g'))"


_CUES_SQL = (
    r"""
WITH d AS (SELECT doc_id AS id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]') AS l FROM documents WHERE starts_with(text, 'WEBVTT')),
x AS (SELECT id, unnest(range(len(l))) AS i, regexp_replace(unnest(l), '^\s+|\s+$', '', 'g') AS line FROM d),
"""
    + f"""
k AS (SELECT *, CASE WHEN regexp_matches(line, '{captions.STAMP}') THEN 1 WHEN regexp_matches(line, '{_HEADER_RX}') THEN 2 ELSE 0 END AS kind FROM x),
g AS (SELECT *, sum(CASE WHEN kind > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM k),
h AS (SELECT id, g, regexp_extract(line, '{captions.STAMP}', 1) AS a, regexp_extract(line, '{captions.STAMP}', 2) AS b, row_number() OVER (PARTITION BY id ORDER BY g) - 1 AS cue_no FROM g WHERE kind = 1),
b AS (SELECT id, g, i, {_line_sql("line")} AS line FROM g WHERE kind = 0),
"""
    + r"""
c AS (SELECT h.id, h.g, cue_no, CAST(split_part(a, ':', 1) AS DOUBLE) * 3600 + CAST(split_part(a, ':', 2) AS DOUBLE) * 60 + CAST(split_part(a, ':', 3) AS DOUBLE) AS start_sec,
  CAST(split_part(b, ':', 1) AS DOUBLE) * 3600 + CAST(split_part(b, ':', 2) AS DOUBLE) * 60 + CAST(split_part(b, ':', 3) AS DOUBLE) AS end_sec FROM h),
bl AS (SELECT id, g, list(line ORDER BY i) AS l FROM b WHERE line <> '' GROUP BY ALL),
cues AS (SELECT c.id, cue_no, start_sec, end_sec, l, array_to_string(l, chr(10)) AS t FROM c JOIN bl USING (id, g))
"""
)
_SETTLED_SQL = (
    _CUES_SQL
    + """, q AS (SELECT *, lag(l[-1]) OVER (PARTITION BY id ORDER BY cue_no) AS tail FROM cues),
r AS (SELECT id, cue_no, start_sec, end_sec, CASE WHEN tail IS NULL THEN l ELSE l[1 + len(list_filter(range(1, len(l) + 1), lambda i: len(list_filter(l[1:i], lambda x: x <> tail)) = 0)):] END AS l FROM q)
"""
)


def _cues(spark, directory) -> DataFrame:
    return captions.parse_captions(table(spark, directory, "documents").filter(F.col("text").startswith("WEBVTT")), "doc_id", "text")


@R.query(_CUES_SQL + "SELECT id AS doc_id, CAST(cue_no AS INT) AS cue_no, round(start_sec, 3) AS start_sec, round(end_sec, 3) AS end_sec, t AS text FROM cues")
def caption_cues(spark, directory) -> DataFrame:
    """SRC-02, STR-01, STR-02, TIM-01, WIN-06: cues of the caption texts."""
    return _cues(spark, directory).select(F.col("id").alias("doc_id"), "cue_no", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"), F.array_join("lines", "\n").alias("text"))


@R.query(_SETTLED_SQL + "SELECT id AS doc_id, CAST(cue_no AS INT) AS cue_no, array_to_string(l, chr(10)) AS text FROM r WHERE len(l) > 0")
def rollup_removed(spark, directory) -> DataFrame:
    """WIN-05, ARR-01: cues without lines rolled up from the cue before."""
    return captions.drop_rollup(_cues(spark, directory)).select(F.col("id").alias("doc_id"), "cue_no", F.array_join("lines", "\n").alias("text"))


_ENDS_SQL = "coalesce(list_max(list_filter(range(1, len({w}) + 1), lambda i: regexp_matches({w}[i], '[.!?]$'))), 0)"


@R.query(
    _SETTLED_SQL
    + r""", p AS (SELECT *, (start_sec + end_sec) / 2 AS mid, array_to_string(l, ' ') AS line FROM r),
w AS (SELECT *, unnest(range(CAST(greatest(0, floor((mid - 30) / 25) + 1) AS BIGINT), CAST(floor(mid / 25) AS BIGINT) + 1)) AS window_no FROM p),
gw AS (SELECT id, window_no, arg_min(start_sec, cue_no) AS start_sec, arg_max(end_sec, cue_no) AS end_sec, list_filter(string_split_regex(array_to_string(list(line ORDER BY cue_no), ' '), '\s+'), lambda x: x <> '') AS tok FROM w GROUP BY ALL),
"""
    + f"""
s1 AS (SELECT *, {_ENDS_SQL.format(w="tok")} AS e FROM gw WHERE len(tok) > 0),
s2 AS (SELECT * REPLACE (CASE WHEN e > 0 AND len(tok) - e <= 12 THEN tok[1:e] ELSE tok END AS tok) FROM s1),
s3 AS (SELECT *, tok[1:512] AS cut FROM s2),
s4 AS (SELECT *, {_ENDS_SQL.format(w="cut")} AS ce FROM s3),
s5 AS (SELECT *, CASE WHEN len(tok) > 512 AND ce > 0 AND length(array_to_string(cut[1:ce], ' ')) >= floor(length(array_to_string(cut, ' ')) * 0.9) THEN ce ELSE len(cut) END AS n FROM s4)
SELECT id AS doc_id, window_no, round(start_sec, 3) AS start_sec, round(end_sec, 3) AS end_sec, array_to_string(cut[1:n], ' ') AS text, CAST(n AS INT) AS token_count FROM s5"""
)
def fixed_window_chunks(spark, directory) -> DataFrame:
    """JOIN-08, WIN-05, WIN-08, STR-03, STR-04, STR-05, AGG-26, AGG-27: 30 s windows every 25 s over cue midpoints."""
    w = captions.fixed_windows(captions.settle_rollup(_cues(spark, directory)))
    return w.select(F.col("id").alias("doc_id"), "window_no", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"), "text", "token_count")


@R.query(
    "WITH RECURSIVE "
    + _SETTLED_SQL.strip().removeprefix("WITH")
    + r""", p AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY cue_no) AS n, start_sec, end_sec, array_to_string(l, ' ') AS line FROM r WHERE len(l) > 0),
f AS (
  SELECT id, n, start_sec AS s, end_sec AS e, line AS t, (end_sec - start_sec >= 30 AND regexp_matches(rtrim(line), '[.!?]$')) OR len(regexp_extract_all(line, '\S+')) >= 512 AS closed, 0 AS chunk_no FROM p WHERE n = 1
  UNION ALL
  SELECT id, n, s, e, t, (e - s >= 30 AND regexp_matches(rtrim(t), '[.!?]$')) OR len(regexp_extract_all(t, '\S+')) >= 512, chunk_no FROM (
    SELECT p.id, p.n, CASE WHEN f.closed THEN p.start_sec ELSE f.s END AS s, p.end_sec AS e, CASE WHEN f.closed THEN p.line ELSE f.t || ' ' || p.line END AS t, f.chunk_no + CASE WHEN f.closed THEN 1 ELSE 0 END AS chunk_no
    FROM f JOIN p ON p.id = f.id AND p.n = f.n + 1))
SELECT id AS doc_id, chunk_no, round(arg_max(s, n), 3) AS start_sec, round(arg_max(e, n), 3) AS end_sec, array_to_string(regexp_extract_all(arg_max(t, n), '\S+')[1:512], ' ') AS text,
  CAST(least(512, len(regexp_extract_all(arg_max(t, n), '\S+'))) AS INT) AS token_count FROM f GROUP BY id, chunk_no"""
)
def sentence_chunks(spark, directory) -> DataFrame:
    """WIN-05, WIN-09, STR-06, UDF-08: chunks closed at sentence ends."""
    s = captions.sentence_sessions(captions.drop_rollup(_cues(spark, directory)))
    return s.select(F.col("id").alias("doc_id"), "chunk_no", F.round("start_sec", 3).alias("start_sec"), F.round("end_sec", 3).alias("end_sec"), "text", "token_count")


@R.query(
    _CUES_SQL
    + r""", m AS (SELECT id, min(start_sec) AS a FROM cues GROUP BY id),
z AS (SELECT cues.*, start_sec - a AS s, end_sec - a AS e FROM cues JOIN m USING (id)),
kc AS (SELECT id, cue_no, greatest(s, 10) - 10 AS s, least(e, 60) - 10 AS e FROM z WHERE e > 10 AND s < 60)
SELECT id AS doc_id, CAST(cue_no AS INT) AS cue_no,
  printf('%02d:%02d:%02d.%03d', CAST(round(s * 1000) AS BIGINT) // 3600000, CAST(round(s * 1000) AS BIGINT) // 60000 % 60, CAST(round(s * 1000) AS BIGINT) // 1000 % 60, CAST(round(s * 1000) AS BIGINT) % 1000) AS start_clock,
  printf('%02d:%02d:%02d.%03d', CAST(round(e * 1000) AS BIGINT) // 3600000, CAST(round(e * 1000) AS BIGINT) // 60000 % 60, CAST(round(e * 1000) AS BIGINT) // 1000 % 60, CAST(round(e * 1000) AS BIGINT) % 1000) AS end_clock FROM kc"""
)
def clip_rebase(spark, directory) -> DataFrame:
    """TIM-02, TIM-03, SNK-19: the stretch from second 10 to 60 of every caption text, rebased to 0."""
    cues = _cues(spark, directory)
    first = cues.groupBy("id").agg(F.min("start_sec").alias("a"))
    moved = cues.join(first, "id").withColumn("start_sec", F.col("start_sec") - F.col("a")).withColumn("end_sec", F.col("end_sec") - F.col("a"))
    clip = captions.clip_cues(moved, 10, 60)
    return clip.select(F.col("id").alias("doc_id"), "cue_no", seconds_clock(F.col("start_sec")).alias("start_clock"), seconds_clock(F.col("end_sec")).alias("end_clock"))


@R.query(
    _CUES_SQL
    + r""", l AS (SELECT id, unnest(string_split(t, chr(10))) AS line FROM cues WHERE t <> ''),
a AS (SELECT id, sum(len(regexp_extract_all(line, '[\w'']+'))) AS words, count(*) AS n, count(*) FILTER (regexp_matches(line, '""" + captions.NO_SPEECH + r"""')) AS m FROM l GROUP BY id),
s AS (SELECT id, max(end_sec) AS sec FROM cues GROUP BY id)
SELECT id AS doc_id, round(words / greatest(sec / 60, 1e-9), 3) AS words_per_minute, round(m / greatest(n, 1), 6) AS non_speech, words / greatest(sec / 60, 1e-9) >= 60 AND m / greatest(n, 1) < 0.2 AS passes FROM s JOIN a USING (id)"""
)
def caption_quality(spark, directory) -> DataFrame:
    """AGG-28, STR-18: words a minute and share of non-speech lines."""
    return captions.caption_quality(_cues(spark, directory)).withColumnRenamed("id", "doc_id")


@R.query(f"SELECT doc_id, {_line_sql('text')} AS text FROM documents WHERE text IS NOT NULL")
def cleaned_text(spark, directory) -> DataFrame:
    """STR-01, STR-16: texts without tags, entities and uneven white space."""
    return table(spark, directory, "documents").filter("text IS NOT NULL").select("doc_id", clean_line(F.col("text")).alias("text"))


@R.query(
    r"""WITH c AS (SELECT DISTINCT chunk_id, text, token_count FROM chunks)
SELECT chunk_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS counted, token_count IS DISTINCT FROM CAST(len(regexp_extract_all(text, '\S+')) AS INT) AS wrong, regexp_matches(rtrim(text), '[.!?]$') AS ends FROM c WHERE text IS NOT NULL"""
)
def token_audit(spark, directory) -> DataFrame:
    """STR-03, STR-06: counted tokens against the recorded count."""
    c = table(spark, directory, "chunks").select("chunk_id", "text", "token_count").distinct().filter("text IS NOT NULL")
    n = token_count(F.col("text"))
    return c.select("chunk_id", n.cast("bigint").alias("counted"), (~F.col("token_count").eqNullSafe(n)).alias("wrong"), F.rtrim("text").rlike(r"[.!?]$").alias("ends"))
