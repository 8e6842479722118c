import re

from pyspark.sql import functions as F

from talkgrid.operators import answering as a


def test_json_reading(spark):
    raws = ['```json\n{"confidence": 1.7}\n```', 'text {"confidence": 0.2} text', "nothing", None, '{"confidence": "x"}', '{"ok": true}', '{"ok": "true"}', '{"ok": 1}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    rows = df.select("i", a.confidence(F.col("raw")).alias("c"), a.literal_true(F.col("raw"), "$.ok").alias("t")).orderBy("i").collect()
    assert [r.c for r in rows[:5]] == [1.0, 0.2, 0.5, 0.5, 0.5] and [r.t for r in rows[4:]] == [False, True, False, False]


def test_aligned_flags(spark):
    raw = '{"claims": [{"index": 1, "grounded": false}, {"index": 1, "grounded": true}, {"index": 7, "grounded": true}, {"index": 0, "grounded": "true"}]}'
    df = spark.createDataFrame([("x", raw, 3), ("y", "broken", 1), ("z", raw, 0)], "k string, raw string, n int")
    got = {(r.k, r.position): r.grounded for r in a.aligned_flags(df, "k", "raw", "n").collect()}
    assert got == {("x", 0): False, ("x", 1): True, ("x", 2): False, ("y", 0): False}


def test_citations(spark):
    cites = [(0, "v", 10.0, 20.0), (2, "v", 10.0, 20.0), (1, "v", 10.0, 10.0), (1, "w", 10.0, 20.0), (1, "v", 18.0, 28.0)]
    ans = spark.createDataFrame([("q", 2, cites)], "qid string, n_claims int, citations array<struct<claim int, video_id string, start_sec double, end_sec double>>")
    chunks = spark.createDataFrame([("q", 1, 1, "v", 0.0, 16.0), ("q", 2, 2, "v", 10.0, 30.0), ("q", 3, 3, "v", 0.0, 40.0)], "qid string, chunk_id int, rank int, video_id string, start_sec double, end_sec double")
    got = [(r.chunk_id, r.share, r.reason) for r in a.valid_citations(ans, chunks).orderBy("n").collect()]
    assert got == [(2, 1.0, None), (2, 1.0, "claim index"), (1, 0.0, "empty span"), (None, 0.0, "no chunk"), (2, 1.0, None)]


def test_loop_is_bounded_and_refines(spark):
    queries = spark.createDataFrame([("sure", "one"), ("later", "two"), ("never", "three")], "qid string, query string")
    channel = lambda q: q.select("qid", F.explode(F.array(F.lit(1), F.lit(2))).alias("chunk_id"), F.lit(1).alias("rank"))
    rerank = lambda p: p.withColumn("score", F.col("chunk_id").cast("double"))
    judge = lambda q: q.select("qid", F.when(F.col("query").isin("one", "two again"), '{"confidence": 0.9}').when(F.col("qid") == "later", '{"confidence": 0.1, "refined_query": "two again"}').otherwise("broken").alias("raw"))
    out = a.Loop({"a": channel, "b": channel}, rerank, judge).run(queries).collect()
    assert {(r.qid, r.query, r.round) for r in out} == {("sure", "one", 0), ("later", "two again", 1), ("never", "three", 2)}
    assert {(r.chunk_id, r.rank) for r in out if r.qid == "never"} == {(2, 1), (1, 2)}


def test_trace_and_ids(spark):
    rows = [("t", "root", None, 0, 100), ("t", "a", "root", 10, 40), ("t", "b", "root", 40, 90)]
    df = spark.createDataFrame(rows, "t string, s string, p string, b bigint, e bigint").withColumn("b", F.timestamp_millis("b")).withColumn("e", F.timestamp_millis("e"))
    assert {(r.span, r.ms, r.own_ms) for r in a.trace_spans(df, "t", "s", "p", "b", "e").collect()} == {("root", 100, 20), ("a", 30, 30), ("b", 50, 50)}
    u = spark.range(1).select(a.uuid7(F.lit(1700000000000)).alias("u")).first().u
    assert re.fullmatch(r"018bcfe5-6800-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", u)
