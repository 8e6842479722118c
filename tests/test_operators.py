import os
import random

import pytest
from pyspark.sql import functions as F

from talkgrid.functions.columns import clean_line, clock_seconds, seconds_clock
from talkgrid.functions.text import edits_within, same_word, words
from talkgrid.operators import captions, fusion, merge
from talkgrid.operators.intervals import bin_range_join, coalesce_intervals, interval_gaps, periods_and_gaps
from talkgrid.operators.skew import salted_join
from talkgrid.operators.vectors import exact_search, mean_pool
from talkgrid.sources import files
from talkgrid.streaming import events
from talkgrid.tables import once, small


def merged(spans):
    out = []
    for s, e in sorted((s, e) for s, e in spans if s is not None and e is not None and e > s):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", range(4))
def test_coalesce_matches_a_plain_merge(spark, seed):
    rng = random.Random(seed)
    rows = []
    for v in ("a", "b", None):
        for _ in range(150):
            s = rng.randrange(-5000, 40000)
            rows.append((v, s, s + rng.choice([-5, 0, 3, 40, 900, 25000 if rng.random() < 0.05 else 10]), "x"))
    rows += [("a", None, 5, "x"), ("a", 5, None, "x"), ("big", 0, 10**12, "x"), ("big", 10**12, 10**12 + 5, "x"), ("big", 10**12 + 50, 10**12 + 60, "x")]
    df = spark.createDataFrame(rows, "v string, s bigint, e bigint, entity string")
    periods = coalesce_intervals(df, "v", "s", "e", shard_ms=1000).cache()
    got = sorted((str(r.entity), r.s, r.e) for r in periods.collect())
    want = sorted((str(v), s, e) for v in {r[0] for r in rows} for s, e in merged([(r[1], r[2]) for r in rows if r[0] == v]))
    assert got == want
    gaps = sorted((str(r.entity), r.s, r.e) for r in interval_gaps(periods, 50, shard_ms=700).collect())
    expect = []
    for v in {r[0] for r in rows}:
        m = merged([(r[1], r[2]) for r in rows if r[0] == v])
        expect += [(str(v), a[1], b[0]) for a, b in zip(m, m[1:]) if b[0] - a[1] <= 50]
    assert gaps == sorted(expect)


@pytest.mark.parametrize("seed", range(3))
def test_long_intervals_change_no_shard(spark, seed):
    rng = random.Random(seed)
    rows = [("hot", s, s + rng.choice([1, 5, 30, 99])) for s in (rng.randrange(60000) for _ in range(800))]
    rows += [("hot", s, s + rng.choice([100, 350, 900, 7000])) for s in (rng.randrange(50000) for _ in range(12))] + [("hot", 20000, 20000 + 10**9 if seed else 33333), (None, 150, 950)]
    df = spark.createDataFrame(rows, "v string, s bigint, e bigint")
    got = sorted((str(r.entity), r.s, r.e) for r in coalesce_intervals(df, "v", "s", "e", shard_ms=100).collect())
    assert got == sorted((str(v), s, e) for v in ("hot", None) for s, e in merged([r[1:] for r in rows if r[0] == v]))
    both = [(r.kind, r.s, r.e) for r in periods_and_gaps(coalesce_intervals(df, "v", "s", "e", shard_ms=100), 40, shard_ms=300).filter("entity = 'hot'").collect()]
    m = merged([r[1:] for r in rows if r[0] == "hot"])
    assert sorted(both) == sorted([("period", *x) for x in m] + [("gap", a[1], b[0]) for a, b in zip(m, m[1:]) if b[0] - a[1] <= 40])


def test_coalesce_of_nothing(spark):
    empty = spark.createDataFrame([], "v string, s bigint, e bigint")
    assert coalesce_intervals(empty, "v", "s", "e").count() == 0
    assert interval_gaps(coalesce_intervals(empty, "v", "s", "e")).count() == 0


def test_range_join_matches_nested_loops(spark):
    rng = random.Random(5)
    pts = [(i, rng.choice(["a", "b", None]), rng.choice([None, rng.uniform(-100, 90000)])) for i in range(300)]
    spans = [(i, rng.choice(["a", "b", None]), s, s + rng.choice([-1, 0, 10, 4000, 80000])) for i, s in enumerate(rng.uniform(-200, 80000) for _ in range(150))]
    p = spark.createDataFrame(pts, "i int, v string, t double")
    q = spark.createDataFrame(spans, "j int, v string, s double, e double")
    got = sorted((r.i, r.j) for r in bin_range_join(p, q, "v", "t", "s", "e", 60.0, 8).collect())
    want = sorted((i, j) for i, v, t in pts for j, w, s, e in spans if v is not None and v == w and t is not None and s <= t < e)
    assert got == want


def test_exact_search_and_pool(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (1, [1.0, 0.0])], "id int, vec array<double>")
    q = rows.filter("id in (1, 4)").withColumnRenamed("id", "qid")
    got = [(r.qid, r.id, r.rank) for r in exact_search(q, rows, 2).orderBy("qid", "rank").collect()]
    assert got == [(1, 1, 1), (1, 3, 2)]
    assert exact_search(q.limit(0), rows, 2).count() == 0
    pool = {r.id: r.pooled for r in mean_pool(spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", None)], "id string, v array<double>"), "id", "v").collect()}
    assert pool == {"a": [2.0, 3.0]}


def test_fusion_closed_form(spark):
    rows = [("q", "c1", "a", 1), ("q", "c1", "b", 2), ("q", "c2", "a", 1), ("q", "c2", "b", None)]
    out = fusion.reciprocal_rank_fusion(spark.createDataFrame(rows, "q string, ch string, i string, r int"), "q", "i", "ch", "r").orderBy("rank").collect()
    assert [(r.i, round(r.score, 9)) for r in out] == [("a", round(2 / 61, 9)), ("b", round(1 / 62, 9))]
    assert out[0].channel_ranks == {"c1": 1, "c2": 1}


def test_kappa(spark):
    pairs = spark.createDataFrame([(1, 1), (2, 2), (1, 2), (2, 2), (None, 1)], "a int, b int")
    row = fusion.agreement_kappa(pairs, "a", "b", [1, 2]).first()
    assert row.n == 4 and row.kappa == pytest.approx(0.5)
    same = spark.createDataFrame([(1, 1)], "a int, b int")
    assert fusion.agreement_kappa(same, "a", "b", [1, 2]).first().kappa == 0.0
    with pytest.raises(ValueError):
        fusion.agreement_kappa(same, "a", "b", [1, 2], "cubic")


def test_captions(spark):
    text = "WEBVTT\nKind: captions\n\nlost line\n\n1\n00:00:00.000 --> 00:00:04.000\n<c>hello</c> &amp; world\n\n00:00:04.000 --> 00:00:31.500\nhello & world\nsecond line.\n\n00:00:40.000 --> 00:00:44.000\nlast words"
    cues = captions.parse_captions(spark.createDataFrame([(1, text), (2, None), (3, "")], "i int, t string"), "i", "t").cache()
    assert [(r.cue_no, r.start_sec, r.lines) for r in cues.orderBy("cue_no").collect()] == [(0, 0.0, ["hello & world"]), (1, 4.0, ["hello & world", "second line."]), (2, 40.0, ["last words"])]
    assert [r.lines for r in captions.drop_rollup(cues).orderBy("cue_no").collect()] == [["hello & world"], ["second line."], ["last words"]]
    win = captions.fixed_windows(cues).orderBy("window_no").collect()
    assert [(r.window_no, r.start_sec, r.end_sec) for r in win] == [(0, 0.0, 31.5), (1, 40.0, 44.0)]
    own = captions.sentence_sessions(cues).orderBy("chunk_no").collect()
    assert [(r.start_sec, r.end_sec) for r in own] == [(0.0, 31.5), (40.0, 44.0)]
    clip = captions.clip_cues(cues, 2, 41).orderBy("cue_no").collect()
    assert [(r.start_sec, r.end_sec) for r in clip] == [(0.0, 2.0), (2.0, 29.5), (38.0, 39.0)]
    with pytest.raises(ValueError):
        captions.fixed_windows(cues, 30, 0)


def test_clocks_and_lines(spark):
    row = spark.range(1).select(
        clock_seconds(F.lit("01:02:03.500")).alias("a"), clock_seconds(F.lit("2:03")).alias("b"), seconds_clock(F.lit(3723.5)).alias("c"), seconds_clock(F.lit(-1.0)).alias("d"),
        clean_line(F.lit(">> <i>a</i>&amp;lt;  b ")).alias("e"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e) == (3723.5, None, "01:02:03.500", "00:00:00.000", "a&lt; b")


def test_words():
    assert words("The cаche's​ “Index”!") == ["the", "cache", "index"]
    assert words(None) == [] and same_word("measured", "measurd") and not same_word("cold", "gold2") and not same_word("12345", "12346")
    assert edits_within("golden", "godlen", 1) and not edits_within("golden", "vector", 2)


def test_upsert_and_patch(spark):
    t = spark.createDataFrame([(1, "a", "v"), (2, "b", None)], "k int, x string, vec string")
    s = spark.createDataFrame([(2, "B", None), (3, "C", "w")], "k int, x string, vec string")
    assert sorted(tuple(r) for r in merge.upsert(t, s, ["k"]).collect()) == [(1, "a", "v"), (2, "B", None), (3, "C", "w")]
    s1 = spark.createDataFrame([(1, "A", None)], "k int, x string, vec string")
    assert sorted(tuple(r) for r in merge.upsert(t, s1, ["k"], keep=["vec"]).collect()) == [(1, "A", "v"), (2, "b", None)]
    p = spark.createDataFrame([('{"a": 1, "b": 2}', '{"b": 3, "c": 4}'), (None, '{"c": 1}'), ('{"a": 1}', None)], "d string, p string").select(merge.json_patch(F.col("d"), F.col("p")).alias("m"))
    assert [r.m for r in p.collect()] == [{"a": "1", "b": "3", "c": "4"}, {"c": "1"}, {"a": "1"}]


def test_once_and_small(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (None, "c")], "k int, v string")
    assert sorted(((r.k or 0), r.v) for r in once(df, ["k"]).collect()) == [(0, "c"), (1, "a")]
    # a side of known size is broadcast, one of unknown or larger size is not
    known = spark.range(5).withColumnRenamed("id", "k")
    plan = lambda side: df.join(side, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(small(known)) and "BroadcastHashJoin" not in plan(small(df))
    assert small(known, limit=0) is known


def test_sources(spark, tmp_path):
    p = tmp_path / "g.jsonl"
    p.write_text('{"id": "a", "gold_spans": [{"start_sec": 1.5, "end_sec": 2}]}\n\nnot json\n')
    rows = files.json_lines(spark, str(p), files.GOLD).collect()
    assert [r.id for r in rows] == ["a", None] and rows[1].corrupt == "not json" and rows[0].gold_spans[0].start_sec == 1.5
    c = tmp_path / "l.csv"
    c.write_text("id,score\nx,4\ny,\nz,odd\n")
    assert [r.score for r in files.csv_labels(spark, str(c), ["score"]).collect()] == [4, None, None]
    assert files.file_hashes(spark, str(c)).first().length == len(c.read_bytes())
    assert files.whole_texts(spark, str(c)).first().text.startswith("id,score")
    assert [r.frame_sec for r in files.time_grid(spark.createDataFrame([("v", 25.0), ("w", 0.0)], "v string, d double"), "v", "d", 10.0).collect()] == [0.0, 10.0, 20.0]
    url = spark.createDataFrame([("https://x.y/watch?list=1&v=abc&t=3#q",), ("https://x.y/z#q",)], "u string").select(files.canonical_url(F.col("u")).alias("u"))
    assert [r.u for r in url.collect()] == ["https://x.y/watch?v=abc", "https://x.y/z"]
    j = tmp_path / "d.json"
    j.write_text('{"a": 1}')
    with pytest.raises(ValueError):
        files.json_document(spark, str(j), ["b"])


def test_stream_replay_gives_the_same_table(spark, tmp_path):
    src, out, chk = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "chk")
    schema = "k int, v string, n int"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema).coalesce(1).write.parquet(src)
    sink = events.keep_latest_sink(spark, out, ["k"], "n")
    stream = lambda: events.read_files(spark, src, spark.createDataFrame([], schema).schema, 1)
    events.drain(stream(), sink, chk)
    spark.createDataFrame([(1, "A", 2), (3, "c", 1)], schema).coalesce(1).write.mode("append").parquet(src)
    events.drain(stream(), sink, chk)
    want = [(1, "A", 2), (2, "b", 1), (3, "c", 1)]
    assert sorted(tuple(r) for r in events.read_latest(spark, out).select("k", "v", "n").collect()) == want
    # the last batch once more
    sink(spark.createDataFrame([(1, "A", 2), (3, "c", 1)], schema), 1)
    assert sorted(tuple(r) for r in events.read_latest(spark, out).select("k", "v", "n").collect()) == want


def test_stream_windows(spark, data, tmp_path):
    src = spark.read.parquet(os.path.join(data, "events.parquet")).withColumn("ts", F.col("ts").cast("timestamp"))
    src.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = events.windowed_counts(events.read_files(spark, str(tmp_path / "e"), spark.read.parquet(str(tmp_path / "e")).schema), "ts", "event_type", "value")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(events) AS n FROM hours").first().n == src.count()


def test_salted_join_loses_no_row_of_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i) for i in range(600)] + [(None, 1000)]
    probes = [("hot", "a"), ("hot", "b"), ("k3", "c"), ("none", "d"), (None, "e")]
    got = salted_join(spark.createDataFrame(probes, "x string, p string"), spark.createDataFrame(rows, "x string, r int"), ["x"], "r", 50)
    assert sorted((r.p, r.r) for r in got.collect()) == sorted((p, r) for x, p in probes for y, r in rows if x == y and x is not None)
