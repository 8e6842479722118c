import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgrid.operators import captions, ledger, steps
from talkgrid.sources import catalogs, files
from talkgrid.streaming import events


def test_inserts_refuse_duplicates(spark, tmp_path):
    folder = str(tmp_path / "runs")
    ledger.insert(spark, folder, spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int"), ["id"])
    for rows in ([("b", 3)], [("c", 1), ("c", 2)]):
        with pytest.raises(ledger.DuplicateKey):
            ledger.insert(spark, folder, spark.createDataFrame(rows, "id string, n int"), ["id"])
    assert spark.read.parquet(folder).count() == 2


def test_traces_and_spans(spark):
    traces = spark.createDataFrame([("t1", 1), ("t2", 2)], "trace string, begun int")
    ends = spark.createDataFrame([("t1", 5, "failed"), ("t1", 9, "ok")], "trace string, ended int, status string")
    assert [(r.trace, r.ended, r.status) for r in ledger.trace_rows(traces, ends).orderBy("trace").collect()] == [("t1", 9, "ok"), ("t2", None, "running")]
    spans = ledger.flush_spans(spark.createDataFrame([("t1", ["a", "b"], [1, 2])], "trace string, name array<string>, ms array<int>"), "trace", ["name", "ms"])
    assert [tuple(r) for r in spans.collect()] == [("t1", "a", 1), ("t1", "b", 2)]


def test_queue_hides_what_is_read(spark, tmp_path):
    q = ledger.Queue(spark, str(tmp_path))
    assert q.read("2026-01-01 00:00:00", 30, 5) == []
    q.send(spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "z")], "id string, body string"), "2026-01-01 00:00:00")
    assert [r.id for r in q.read("2026-01-01 00:00:10", 30, 2)] == ["1", "2"] and [r.id for r in q.read("2026-01-01 00:00:20", 30, 5)] == ["3"]
    q.end(["2"])
    again = q.read("2026-01-01 00:00:41", 30, 5)
    assert [(r.id, r.reads) for r in again] == [("1", 1)]
    assert q.purge("2026-01-01 00:01:00") == 2 and q.read("2026-01-02 00:00:00", 0, 5) == []


def test_migrations_run_once_in_order(spark, tmp_path):
    seen = []
    found = {"002_b": lambda s: seen.append("b"), "001_a": lambda s: seen.append("a")}
    assert ledger.migrate(spark, str(tmp_path / "m"), found) == ["001_a", "002_b"] == [f"00{i + 1}_{x}" for i, x in enumerate(seen)]
    assert ledger.migrate(spark, str(tmp_path / "m"), found) == []

    def broken(s):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        ledger.migrate(spark, str(tmp_path / "m"), found | {"003_c": lambda s: None, "004_d": broken})
    assert {r.name for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {"001_a", "002_b", "003_c"}


def test_small_expressions(spark):
    r = spark.range(1).select(ledger.backoff(F.lit(3), 0.5).alias("w"), ledger.run_id("bakeoff").alias("r")).first()
    assert r.w == 4.0 and len(r.r) == 20 and r.r.startswith("bakeoff-")
    with pytest.raises(KeyError, match="fixed_window"):
        captions.chunker("none")


def test_chunkers_and_clip_writer(spark, tmp_path):
    text = "WEBVTT\n\n00:00:01.000 --> 00:00:03.000\none two.\n\n00:00:04.000 --> 00:00:40.000\nthree four.\n"
    cues = captions.parse_captions(spark.createDataFrame([("v", text)], "i string, t string"), "i", "t")
    assert captions.chunker("transcript_segment")(cues).count() == 1 and captions.chunker("fixed_window")(cues).count() >= 1
    captions.write_captions(captions.clip_cues(cues, 2.0, 10.0), str(tmp_path / "clips"))
    back = files.whole_texts(spark, str(tmp_path / "clips" / "id=v")).first().text
    again = captions.parse_captions(spark.createDataFrame([("v", back)], "i string, t string"), "i", "t").orderBy("cue_no").collect()
    assert [(r.start_sec, r.end_sec, r.lines) for r in again] == [(0.0, 1.0, ["one two."]), (2.0, 8.0, ["three four."])]


def test_catalogues(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "talks.yaml"
    path.write_text("talks:\n- id: a\n  component: dense\n  provider: local\n  channels: [dense, sparse]\n  at: 2026-01-01T00:00:00Z\n- id: b\n  component: rerank\n  provider: cloud\n  channels: []\n")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "component", "provider")] + [T.StructField("channels", T.ArrayType(T.StringType())), T.StructField("at", T.TimestampType())])
    df = catalogs.yaml_entries(spark, str(path), schema, "talks")
    assert catalogs.lookup(df, id="a")["channels"] == ["dense", "sparse"] and df.filter("id = 'a'").first()["at"].year == 2026
    for key in ({"id": "z"}, {"component": "none"}):
        with pytest.raises(KeyError):
            catalogs.lookup(df, **key)
    assert catalogs.local_candidates(df, "dense", ["dense"]).count() == 1
    with pytest.raises(ValueError):
        catalogs.local_candidates(df, "rerank", [])
    with pytest.raises(ValueError):
        catalogs.local_candidates(df, "dense", ["visual"])
    with pytest.raises(ValueError):
        catalogs.yaml_entries(spark, str(path), schema)


def test_lines_evidence_and_paths(spark, tmp_path):
    path = tmp_path / "gold.jsonl"
    path.write_text('{"id": "a", "visual_evidence": [{"visual_element": "title", "required_any": ["Big  Table", "x9"]}, {"visual_element": "axis", "required_any": ["MS"], "normalize": "exact"}]}\n\n{broken\n')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("visual_evidence", T.ArrayType(catalogs.EVIDENCE))])
    rows = catalogs.numbered_json_lines(spark, str(path), schema)
    assert [(r.line, r.id, r.corrupt) for r in rows.orderBy("line").collect()] == [(1, "a", None), (3, None, "{broken")]
    items = catalogs.visual_evidence(rows.filter("id IS NOT NULL"))
    hits = lambda texts: [tuple(r) for r in catalogs.evidence_hits(items, spark.createDataFrame(texts, "id string, text string")).collect()]
    assert hits([("a", "a big table"), ("a", "12 MS")]) == [("a", True, "Big  Table AND MS", None)]
    assert hits([("a", "a big table 12 ms")]) == [("a", False, "Big  Table", "term missing")] and hits([("b", "x")]) == [("a", False, "", "no text")]
    with pytest.raises(ValueError):
        catalogs.visual_evidence(spark.createDataFrame([("a", [("t", [], None)])], schema))
    with pytest.raises(ValueError):
        catalogs.normalized(F.lit("x"), "odd")
    talks, own = spark.createDataFrame([("a",), ("b",)], "video_id string"), spark.createDataFrame([("b", "/x/b.mp4")], "video_id string, path string")
    assert sorted(r.path for r in catalogs.fetch_paths(talks, own, "/v/").collect()) == ["/v/a.mp4", "/x/b.mp4"]
    prompt = tmp_path / "p.md"
    prompt.write_text("judge")
    assert catalogs.prompt_hash(spark, str(prompt)) == hashlib.sha256(b"judge").hexdigest()[:12]
    made = []
    make = lambda keys: (made.append(1), keys.withColumn("v", F.lit(1.0)))[1]
    keys = spark.createDataFrame([("a",), ("b",)], "video_id string")
    for k in (keys, keys, keys.limit(1)):
        catalogs.cached_vectors(spark, str(tmp_path / "cache"), k, "video_id", make).count()
    assert len(made) == 2
    files.write_json_lines(keys, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_claimed_steps_on_a_stream(spark, tmp_path):
    rows = [(k, a, n) for k, acts in {"x": "enqueue claim fail claim complete claim", "y": "claim enqueue skip", "z": "enqueue claim fail claim fail claim fail complete"}.items() for n, a in enumerate(acts.split())]
    schema = "k string, a string, n int"
    for part in range(2):
        spark.createDataFrame([r for r in rows if (r[2] > 2) == part], schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    want = {r.k: (r.state, r.attempts, r.acks, r.violations) for r in steps.fold_steps(spark.createDataFrame(rows, schema), ["k"], "a", ["n"]).collect()}
    assert want == {"x": ("completed", 2, 1, 0), "y": ("skipped", 0, 0, 1), "z": ("failed", 3, 0, 1)}
    assert [r.k for r in steps.dead_letters(steps.fold_steps(spark.createDataFrame(rows, schema), ["k"], "a", ["n"])).collect()] == ["z"]
    got = {}
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
    query = steps.stream_steps(stream, "k", "a", "n").writeStream.outputMode("update").foreachBatch(lambda b, i: got.update({r.k: (r.state, r.attempts, r.acks, r.violations) for r in b.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert got == want


def test_sink_rewrites_touched_partitions_only(spark, tmp_path):
    folder = str(tmp_path / "t")
    sink = events.keep_latest_sink(spark, folder, ["k"], "n", parts=8)
    df = lambda rows: spark.createDataFrame(rows, "k string, n int")
    sink(df([(f"k{i}", 1) for i in range(40)]), 0)
    sink(df([("k3", 5), ("k4", 0), ("new", 1)]), 1)
    sink(df([("k3", 5), ("k4", 0), ("new", 1)]), 1)
    sink(df([]), 2)
    got = {r.k: r.n for r in events.read_latest(spark, folder).collect()}
    assert got == {**{f"k{i}": 1 for i in range(40)}, "k3": 5, "new": 1}
    versions = events.part_versions(spark, folder)
    assert len([v for v in versions.values() if v == 2]) <= 3 and len(versions) == 8
    kids = events.fan_out(spark.createDataFrame([("v", [1, 2])], "v string, frames array<int>"), "v", "frames", "embed").collect()
    assert [(r.entity, r.status) for r in kids] == [(1, "pending"), (2, "pending")]


def test_redelivered_events_count_once_on_a_stream(spark, tmp_path):
    rows = [("a", "2026-01-01 00:00:00", 1), ("a", "2026-01-01 00:00:00", 1), ("b", "2026-01-01 00:05:00", 2)]
    schema = "k string, ts timestamp, n int"
    df = spark.createDataFrame(rows, "k string, ts string, n int").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in range(2):
        df.coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    seen = []
    query = events.once_each(spark.readStream.schema(schema).parquet(str(tmp_path / "in/*")), ["k"], "ts").writeStream.foreachBatch(lambda b, i: seen.extend(r.k for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(seen) == ["a", "b"]
