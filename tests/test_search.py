import random

import numpy as np
from pyspark.sql import functions as F

from talkgrid.functions.stem import parse_websearch, stem
from talkgrid.operators import search, vectors


def test_stems():
    pairs = {
        "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "gas": "gas", "agreed": "agre", "feed": "feed", "plastered": "plaster", "hopping": "hop", "hoping": "hope", "falling": "fall", "running": "run", "cry": "cri", "say": "say",
        "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "triplicate": "triplic", "electrical": "electr", "goodness": "good",
        "revival": "reviv", "allowance": "allow", "inference": "infer", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "communism": "communism", "generate": "generat", "generously": "generous", "probate": "probat", "controlling": "control",
        "skies": "sky", "news": "news", "succeed": "succeed", "für": "für", "x9": "x9", "is": "is", "youth": "youth", "knightly": "knight",
    }
    assert {w: stem(w) for w in pairs} == pairs


def test_websearch_syntax():
    words = lambda t: t.lower().replace("-", " ").split()
    assert parse_websearch('"big table" cache -slow', words) == [([["big", "table"], ["cache"]], [["slow"]])]
    assert parse_websearch("a OR b or -c", words) == [([["a"]], []), ([["b"]], [])]
    assert parse_websearch('trade-off "open', words) == [([["trade", "off"], ["open"]], [])] and parse_websearch('-"x y"', words) == [] and parse_websearch("", words) == []


def test_websearch(spark):
    docs = [(1, "The caching policies of large tables"), (2, "cached policy, tables are large"), (3, "a large cache table"), (4, None), (5, "für große Tabellen"), (2, "zz later delivery")]
    asks = [("stems", "cache policy"), ("phrase", '"large tables"'), ("or", '"large cache" OR große'), ("minus", "table -policy"), ("none", "the of"), ("null", None)]
    found = search.websearch(spark.createDataFrame(asks, "q string, t string"), "q", "t", spark.createDataFrame(docs, "i int, t string"), "i", "t", 10).collect()
    got = {}
    for r in found:
        got.setdefault(r.qid, set()).add(r.id)
    assert got == {"stems": {1, 2}, "phrase": {1}, "or": {3, 5}, "minus": {3}}


def test_blocks_find_what_all_pairs_find(spark, monkeypatch):
    monkeypatch.setattr(search, "ROW_BLOCK", 30)
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(25)] + ["common"] * 20
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30)))) for i in range(120)] + [(900, "the of"), (901, None)]
    asks = [(f"q{i}", " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 4)))) for i in range(15)] + [("q0", "zzz zzz"), ("empty", "the")]
    d, q = spark.createDataFrame(docs, "i int, t string"), spark.createDataFrame(asks, "q string, t string")
    rows = search.term_rows(d, "i", "t")
    bags = {i: t.split() for i, t in docs if t and i < 900}
    want = {}
    for name, text in asks[:15]:
        terms = text.split()
        for i, bag in bags.items():
            s = sum(terms.count(w) * bag.count(w) for w in set(terms))
            if s:
                want.setdefault(name, []).append((-float(s), i))
    got = {}
    for r in search.sparse_search(q, "q", "t", rows, 7).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.id, r.score))
    assert {k: [(i, -s) for s, i in sorted(v)[:7]] for k, v in want.items()} == {k: [(i, s) for _, i, s in sorted(v)] for k, v in got.items() if k in want}
    n, mean = len(bags), np.mean([len(b) for b in bags.values()])
    matches = search.bm25(q.filter("q <> 'q0' OR t LIKE 'zzz%'"), "q", "t", rows, 5)
    full = {r.qid for r in search.search_all_terms(matches, 5).collect()}
    for r in search.search_or_fallback(matches, 5).collect():
        terms = set(dict(asks)[r.qid].split()) if r.qid != "q0" else set()
        bag = bags[r.id]
        score = sum(np.log(1 + (n - df + 0.5) / (df + 0.5)) * bag.count(w) * 2.2 / (bag.count(w) + 1.2 * (0.25 + 0.75 * len(bag) / mean)) for w in terms if w in bag for df in [sum(w in b for b in bags.values())])
        assert abs(score - r.score) < 1e-5 and (r.qid not in full or terms <= set(bag))
    assert "q0" not in full and matches.filter("qid = 'empty'").count() == 0


def test_late_interaction_over_parts(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES_PER_TASK", 2)
    rng = np.random.default_rng(2)
    tokens = {i: rng.standard_normal((rng.integers(1, 4), 3)) for i in range(12)}
    rows = [(i, p, [float(x) for x in v]) for i, t in tokens.items() for p, v in enumerate(t)]
    table = spark.createDataFrame(rows, "id int, position int, vec array<double>")
    cands = [(q, c, part) for q in range(5) for c, part in ((100, 3), (100, 4), (101, 7), (102, 99))]
    got = {(r.qid, r.id): r.score for r in vectors.late_interaction(spark.createDataFrame(cands, "qid int, id int, part int"), table.withColumnRenamed("id", "qid"), table, by_part=True).collect()}
    best = lambda q, own: sum(max(float(a @ b) for b in own) for a in tokens[q])
    assert got.keys() == {(q, c) for q in range(5) for c in (100, 101)}
    assert all(abs(got[q, 100] - best(q, np.concatenate([tokens[3], tokens[4]]))) < 1e-5 and abs(got[q, 101] - best(q, tokens[7])) < 1e-5 for q in range(5))
    assert vectors.late_interaction(spark.createDataFrame([], "qid int, id int"), table.withColumnRenamed("id", "qid"), table).count() == 0


def test_mean_pool_by_component(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", None), ("b", [1.0]), ("c", [5.0, 5.0])], "k string, v array<double>")
    assert {r.k: r.pooled for r in vectors.mean_pool(df, "k", "v", 2).collect()} == {"a": [2.0, 4.0], "c": [5.0, 5.0]}
