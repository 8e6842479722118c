"""Queries that do the whole job, against plain Python and SQL without the cut."""

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from talkgrid.functions.columns import tenths
from talkgrid.operators import captions
from talkgrid.plans import catalog, retrieval
from tests.oracle import compare, connect


def test_tenths_as_python_writes_them(spark):
    rng = random.Random(3)
    xs = [0.0, 0.05, 0.15, 0.25, 0.35, 0.45, 0.75, 1.05, 2.675, 96.88, 99.95, 99.949, 1234.25, -0.04, -0.25, -3.35, 4503599627370497.5, 8.9e15]
    xs += [rng.randrange(10**7) / 1000 for _ in range(2000)] + [rng.randrange(10**6) / 20 for _ in range(2000)] + [rng.uniform(0, 1e4) for _ in range(1000)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", tenths(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in rows if r.t != f"{r.x:.1f}"] == []


def test_rendered_context_holds_every_valid_chunk(spark, data):
    sql = """SELECT DISTINCT chunk_id, '[' || video_id || ' @ ' || printf('%.1f', start_sec) || '-' || printf('%.1f', end_sec) || ']' || chr(10) || text AS context
      FROM (SELECT DISTINCT chunk_id, video_id, start_sec, end_sec, text FROM chunks) WHERE end_sec > start_sec AND isfinite(start_sec) AND isfinite(end_sec) AND text IS NOT NULL AND video_id IS NOT NULL"""
    compare(catalog.queries()["rendered_context"](spark, data), connect(data), sql)


def settled(cues):
    out, tail = [], None
    for start, end, lines in cues:
        if not lines:
            continue
        kept = list(lines)
        while kept and kept[0] == tail:
            kept.pop(0)
        tail = kept[-1] if kept else tail
        out.append((start, end, " ".join(kept)))
    return out


def plain_windows(cues, limit):
    out, no = [], 0
    while no * 25 < max((c[1] for c in cues), default=0):
        own = [c for c in cues if no * 25 <= (c[0] + c[1]) / 2 < no * 25 + 30]
        text = " ".join(c[2] for c in own if c[2])
        if text:
            last = max(text.rfind(x) for x in (". ", "! ", "? "))
            if text[-1] not in ".!?" and last >= 0 and len(text[last + 1 :].split()) <= 12:
                text = text[: last + 1]
            if len(text.split()) > limit:
                text = " ".join(text.split()[:limit])
                ends = [m.start() + 1 for m in re.finditer(r"[.!?](?:\s|$)", text) if m.start() + 1 >= int(len(text) * 0.9)]
                text = text[: ends[-1]] if ends else text
            out.append((no, own[0][0], own[-1][1], text, len(text.split())))
        no += 1
    return out


def plain_sentences(cues, limit):
    out, cur = [], []
    for c in [c for c in cues if c[2]]:
        cur.append(c)
        text = " ".join(x[2] for x in cur)
        if (c[1] - cur[0][0] >= 30 and text[-1] in ".!?") or len(text.split()) >= limit:
            kept = text.split()[:limit]
            out.append((len(out), cur[0][0], c[1], " ".join(kept), len(kept)))
            cur = []
    if cur:
        text = " ".join(x[2] for x in cur)
        out.append((len(out), cur[0][0], cur[-1][1], text, len(text.split())))
    return out


def made_captions(rng):
    """Caption texts with rolled-up lines, cues of nothing else, empty cues and sentences of all lengths."""
    at, lines, last = 0.0, ["WEBVTT", ""], None
    for _ in range(rng.randrange(1, 120)):
        long = rng.choice([1.0, 2.5, 4.0, 9.0])
        body = [" ".join(rng.choice(["go", "étude", "cache", "3.5", "end.", "why?"]) if rng.random() < 0.3 else "word" for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(0, 3))]
        if last and rng.random() < 0.5:
            body = [last] + (body if rng.random() < 0.7 else [])
        last = body[-1] if body else last
        clock = [f"{int(t) // 3600:02d}:{int(t) // 60 % 60:02d}:{t % 60:06.3f}" for t in (at, at + long)]
        lines += [" --> ".join(clock), *body, ""]
        at += long + rng.choice([0.0, 0.0, 0.5, 40.0])
    return "\n".join(lines)


def grouped(cues):
    texts = {}
    for r in cues.orderBy("id", "cue_no").collect():
        texts.setdefault(r.id, []).append((r.start_sec, r.end_sec, r.lines))
    return texts


@pytest.mark.parametrize("limit", [20, 512])
def test_chunkers_match_plain_python(spark, limit):
    rng = random.Random(limit)
    docs = spark.createDataFrame([(i, made_captions(rng)) for i in range(80)], "i int, t string")
    cues = captions.parse_captions(docs, "i", "t").cache()
    texts = grouped(cues)
    shape = lambda df, no: sorted((r.id, r[no], r.start_sec, r.end_sec, r.text, r.token_count) for r in df.collect())
    got = shape(captions.fixed_windows(captions.settle_rollup(cues), max_tokens=limit), "window_no")
    assert got == sorted((i, *w) for i, c in texts.items() for w in plain_windows(settled(c), limit))
    got = shape(captions.sentence_sessions(captions.drop_rollup(cues), max_tokens=limit), "chunk_no")
    assert got == sorted((i, *w) for i, c in texts.items() for w in plain_sentences(settled(c), limit))


@pytest.mark.parametrize("name, no, plain", [("fixed_window_chunks", "window_no", plain_windows), ("sentence_chunks", "chunk_no", plain_sentences)])
def test_chunk_queries_take_rolled_up_lines_once(spark, tmp_path, name, no, plain):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, made_captions(rng)) for i in range(30)], "doc_id int, text string")
    docs.write.parquet(os.path.join(tmp_path, "documents.parquet"))
    texts = grouped(captions.parse_captions(docs, "doc_id", "text"))
    got = sorted((r.doc_id, r[no], r.start_sec, r.end_sec, r.text, r.token_count) for r in catalog.queries()[name](spark, str(tmp_path)).collect())
    assert got == sorted((i, w[0], round(w[1], 3), round(w[2], 3), *w[3:]) for i, c in texts.items() for w in plain(settled(c), 512))


def test_maxsim_scores_the_union_of_both_prefilters(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "PREFILTER", 5)
    rng, data = random.Random(4), str(tmp_path)
    rows = [(i, rng.choice(["fixed_window", "fixed_window", "transcript_segment"]), " ".join(rng.choice(["cache", "vector", "stream", "query", "the", "index", "shard"]) for _ in range(8))) for i in range(160)]
    spark.createDataFrame(rows, "chunk_id long, chunking_strategy string, text string").write.parquet(f"{data}/chunks.parquet")
    vecs = [(i, None if i == 7 else [0.0] * 64 if i == 8 else [rng.uniform(-1, 1) for _ in range(64)]) for i in range(160)]
    spark.createDataFrame(vecs, "chunk_id long, dense array<double>").write.parquet(f"{data}/dense_embeds.parquet")
    con = duckdb.connect()
    for t in ("chunks", "dense_embeds"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet/*.parquet'")
    sql = f"""WITH {retrieval._VEC_SQL}, {retrieval._POST_SQL}
      dots AS (SELECT a.id AS query_id, b.id AS chunk_id, sum(a.tf * b.tf) AS dot FROM post a JOIN post b USING (term) WHERE a.id % 50 = 0 AND b.id IN (SELECT chunk_id FROM fw) GROUP BY ALL),
      sp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, chunk_id) AS rank FROM dots),
      cand AS (SELECT query_id, chunk_id FROM d WHERE rank <= 5 UNION SELECT query_id, chunk_id FROM sp WHERE rank <= 5),
      p AS (SELECT c.query_id, c.chunk_id, q.vec AS a, r.vec AS b FROM cand c JOIN v q ON c.query_id = q.chunk_id JOIN v r ON c.chunk_id = r.chunk_id),
      e AS (SELECT query_id, chunk_id, i, max(list_inner_product(a[16 * i + 1 : 16 * i + 16], b[16 * j + 1 : 16 * j + 16])) AS best FROM p, range(4) x(i), range(4) y(j) GROUP BY ALL),
      s AS (SELECT query_id, chunk_id, round(sum(best), 6) AS score FROM e GROUP BY ALL)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s"""
    df = retrieval.maxsim_multivec(spark, data)
    compare(df, con, sql)
    assert df.groupBy("query_id").count().filter("count > 5").count() > 0


def test_upsert_keeps_every_id_and_its_latest_delivery(spark, tmp_path):
    rows = [(i, f"2025-01-0{1 + d}", 10 * i + (5 - d if i % 2 else d), "text") for i in range(14) for d in range(1 + i % 3)]
    df = spark.createDataFrame(rows, "chunk_id long, at string, token_count int, text string").selectExpr("chunk_id", "timestamp(at) AS created_at", "token_count", "text")
    df.write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r.chunk_id: r.n for r in catalog.queries()["upsert_keep_latest"](spark, str(tmp_path)).collect()}
    assert got == {r[0]: r[2] for r in sorted(rows, key=lambda r: (r[0], r[1]))}


def test_caption_lines_are_cleaned_whole(spark):
    text = "WEBVTT\n\n1\n  00:00:01.000 --> 00:00:02.000 align:start\n&gt;&gt; caf&eacute; &#x41;&amp;B <c>x</c>\n 7\r\n00:00:03.000 --> 00:00:04.000\n \n00:00:05.000 --> 00:00:06.000\ru\u2028v\nNOTE gone\nlost\n"
    rows = captions.parse_captions(spark.createDataFrame([(1, text), (2, None), (3, "")], "i int, t string"), "i", "t").collect()
    assert [(r.cue_no, r.start_sec, r.lines) for r in rows] == [(0, 1.0, ["café A&B x", "7"]), (2, 5.0, ["u", "v"])]
