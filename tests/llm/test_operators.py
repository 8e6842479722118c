import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkgrid.llm.functions import onebit
from talkgrid.llm.functions.answers import VOTES, answer_in_raw, dangling_end, language, open_tail, repeats, signals, unbalanced
from talkgrid.llm.functions.passages import gram_hashes, longest_common_run, passage_words, winnow
from talkgrid.llm.functions.pii import Seeds, details, luhn, mod11_10, mod97, redact, spanish
from talkgrid.llm.functions.splitting import split_text, token_spans
from talkgrid.llm.leakage import leaked_passages
from talkgrid.llm import mixing
from talkgrid.llm.mixing import mix_to_targets
from talkgrid.llm.nearest import nearest_in_time
from talkgrid.llm import overlap
from talkgrid.llm.functions.sameness import contained
from talkgrid.llm.overlap import cross_split_overlaps
from talkgrid.llm.functions.labels import label_model
from talkgrid.llm.pairs import defective_pairs
from talkgrid.llm.pii import personal_details
from talkgrid.llm.ranking import net_flow, top_items
from talkgrid.llm.similar import nearest_vectors
from talkgrid.llm.splitting import count_tokens, split_oversized

WORDS = [f"{a}{b}" for a in ("kal", "mor", "ten", "vis", "zur", "pol", "rad", "sil", "gor", "bex") for b in ("an", "id", "os", "ul", "em", "ra", "ot", "ix")]


# --- 1 cross-split overlaps ----------------------------------------------------------------------
def gold(spark, rows):
    return spark.createDataFrame(rows, "id string, question string, ev boolean, v string, at double, w string, x string")


def test_overlaps_find_rewordings_of_the_same_moment_only(spark):
    q = "What does the talk say about the caching policy of the golden set?"
    rows = [
        ("e1", q, True, "v", 10.0, "", ""),
        ("t1", "what doеs the​ talk say about the golden set's cachng policy", False, "v", 15.0, "", ""),
        ("t2", q, False, "v", 15.2, "", ""),
        ("t3", q, False, "w", 10.0, "", ""),
        ("t4", "What does the talk say about the caching policy of the vector index?", False, "v", 10.0, "", ""),
        ("t1", "what doеs the​ talk say about the golden set's cachng policy", False, "v", 15.0, "", ""),
        ("e2", "Is any of this covered at all in the recording?", True, None, None, "", ""),
        ("t5", "Hi, is any of this covered at all in the recording", False, None, None, "", ""),
        ("t6", None, False, None, None, "", ""), ("e3", "", True, None, None, "", ""), ("n", q, None, "v", 10.0, "", ""),
    ]
    filler = [(f"f{i}", f"What does the talk say about the {WORDS[i % 80]} {WORDS[(7 * i) % 80]} of the {WORDS[(3 * i + 1) % 80]}?", i % 4 == 0, f"x{i}", float(i), "", "") for i in range(120)]
    found = {(r.e_id, r.t_id) for r in cross_split_overlaps(gold(spark, rows + filler), "id", "question", "ev", ["v"], "at", 5.0).records().collect()}
    assert found == {("e1", "t1"), ("e2", "t5")}
    none = cross_split_overlaps(gold(spark, []), "id", "question", "ev", ["v"], "at", 5.0)
    assert none.records().count() == 0 and none.counts().count() == 0


def test_contained_is_of_the_evaluation_record():
    long = "what is the reason that the golden cache of this service was moved to another region last year".split()
    assert contained(long[:9], long) and not contained(long, long[:9]) and not contained(long, ["why"]) and not contained(long, "what is the".split())
    assert contained(["why"], ["why"]) and not contained(["why"], ["why", "not"]) and not contained([], ["why"]) and not contained(["why"], [])
    assert contained(long[:9], [*(f"x{i}" for i in range(300)), *long[:9], "end"]) and not contained("how did they fill the cache".split(), "how did they fill the queue".split())
    assert contained("how does the presenter fill the cache".split(), "how does the speakker fill the cache".split())


def test_overlaps_match_all_pairs(spark, monkeypatch):
    """Equal to brute force: unequal lengths, fragments, slips, copies and one hot place with salted words."""
    monkeypatch.setattr(overlap, "SALT_ROWS", 40)
    rng = random.Random(2)
    rows = []
    slip = lambda w: w[:2] + w[3:] if len(w) > 3 and rng.random() < 0.15 else w
    for i in range(220):
        t = [rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 9, 14, 19]))]
        place, at = rng.choice([("hot", None), ("hot", None), ("a", float(rng.randrange(40))), ("b", float(rng.randrange(40)))])
        rows.append((f"e{i}", " ".join(t), True, place, at, "", ""))
        for j in range(rng.randrange(3)):
            u = [slip(w) for w in t]
            kind = rng.randrange(6)
            if kind == 0:
                rng.shuffle(u)
            elif kind == 1:
                u = u[: max(1, len(u) // 2)]
            elif kind == 2:
                u = [rng.choice(WORDS) for _ in range(rng.choice([2, 30, 70]))] + u + [rng.choice(WORDS) for _ in range(5)]
            elif kind == 3:
                u.insert(len(u) // 2, "please")
            elif kind == 4:
                u[rng.randrange(len(u))] = rng.choice(WORDS)
            rows.append((f"t{i}.{j}", " ".join(u), False, place, None if at is None else at + rng.randrange(-7, 8), "", ""))
    rows += [(f"c{i}", "kalan kalid kalos kalul morid", False, "hot", None, "", "") for i in range(90)] + [("ec", "kalan kalid kalos kalul morid", True, "hot", None, "", "")]
    got = cross_split_overlaps(gold(spark, rows), "id", "question", "ev", ["v"], "at", 5.0)
    found = {(r.e_id, r.t_id) for r in got.records().collect()}
    near = lambda a, b: a[3] == b[3] and ((a[4] is None and b[4] is None) or (a[4] is not None and b[4] is not None and abs(a[4] - b[4]) <= 5))
    want = {(a[0], b[0]) for a in rows for b in rows if a[2] and not b[2] and near(a, b) and contained(a[1].split(), b[1].split())}
    assert found == want and len(want) > 150
    per = {}
    for e, _ in want:
        per[e] = per.get(e, 0) + 1
    assert {r.e_id: r.pairs for r in got.counts().collect()} == per


# --- 3 similar vectors ---------------------------------------------------------------------------
def test_one_bit_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 96))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rot, center = onebit.rotation(96), x[:50].mean(axis=0)
    codes = onebit.Codes(*onebit.encode(x, center, rot), center, rot, 2.6)
    low, high = codes.lower(codes.queries(x[:40])), codes.upper(codes.queries(x[:40]))
    assert codes.matrix.shape == (400, 99) and set(np.unique(onebit.signs(onebit.pack(x > 0), 96))) == {-1.0, 1.0}
    true = x[:40] @ x.T
    assert ((low <= true) & (true <= high)).mean() > 0.98


def test_similar_vectors_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((12, 64))
    x = centers[rng.integers(0, 12, 500)] + 0.35 * rng.standard_normal((500, 64))
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x.astype(np.float32))]
    hot = rows[3][1]
    rows += [(1000 + i, hot, 0) for i in range(200)]  # a quarter of all rows are copies
    rows += [(5000, None, 0), (5001, [0.0] * 64, 0), (5002, [float("nan")] * 64, 0), (5003, [1.0, 2.0], 0), (None, hot, 0), (4, rows[4][1], 0), (5004, [None] * 64, 0)]
    df = spark.createDataFrame(rows, "chunk bigint, dense array<float>, vid int")
    got = nearest_vectors(df, "chunk", "dense", 5, 0.5, list_rows=40, block_rows=24, margin=0.4).collect()
    ids = [r[0] for r in rows if r[0] is not None and r[0] < 5000][:700]
    vec = {r[0]: np.array(r[1], dtype=np.float64) for r in rows if r[0] in set(ids)}
    ids = sorted(vec)
    m = np.array([vec[i] / np.linalg.norm(vec[i]) for i in ids])
    sims = np.round(m @ m.T, 6)
    own = {}
    for r in got:
        own.setdefault(r.id, []).append((r.neighbour, r.sim))
    hits = total = 0
    for a, i in enumerate(ids):
        s = np.delete(sims[a], a)
        best = np.sort(s)[::-1][:5]
        best = best[best >= 0.5]
        total += len(best)
        mine = sorted((x for _, x in own.get(i, [])), reverse=True)
        assert len(mine) <= 5 and i not in [n for n, _ in own.get(i, [])]
        hits += sum(abs(x - y) < 1e-4 for x, y in zip(mine, best))
    assert hits >= 0.95 * total
    # all copies see the smallest ids among the copies
    assert sorted(n for n, _ in own[1150]) == [3, 1000, 1001, 1002, 1003]
    assert nearest_vectors(df.limit(0), "chunk", "dense").count() == 0
    assert nearest_vectors(df.filter("chunk = 7"), "chunk", "dense").count() == 0


# --- 4 broken pairs ------------------------------------------------------------------------------
def fired(*args):
    return {name for (_, name, _), on in zip(VOTES, signals(*args)) if on}


def test_signals():
    q = "What does the talk say about the caching policy?"
    assert "no_letters" in fired(q, " ​- ", None, True, None) and "placeholder" in fired(q, "**N/A**", None, True, None)
    declined = fired(q, "I'm sorry, but I can't answer that from the clips provided. Try rephrasing it.", None, True, None)
    assert "declines" in declined and "says_more" not in declined
    assert "says_more" in fired(q, "I can't be sure of the exact figure, but the speaker puts it near 3 rows. It keeps its cache small.", None, True, None)
    assert "repeats" in fired(q, "Question: what does the talk say about the caching policy", None, True, None)
    assert "function_words" in fired(q, "Der Sprecher sagt, dass die Daten nicht mehr in den Speicher passen.", None, True, None)
    assert fired(None, None, None, None, None) >= {"no_letters"}
    assert unbalanced('he calls it "a') and not unbalanced('he calls it "a dog"') and open_tail("All went well. Then the que") and not open_tail("The talk lists two parts:\n- the a\n- the b")
    assert dangling_end("It handles 57 rows and hands the rest to,") and dangling_end("The data contract of the") and not dangling_end("They do not address this.")
    assert answer_in_raw('```json\n{"answer": "It is \\"so\\"", "x": 1') == ('It is "so"', False) and answer_in_raw('{"answer": "It br') == ("It br", True)
    assert answer_in_raw("```json\n```") == ("", False) and answer_in_raw(None) == ("", False) and answer_in_raw('{"answer": null}') == ("", False)
    assert language("the cat is in the house".split()) == "en" and language(["roughly", "40"]) is None
    assert repeats("why is the sky blue".split(), "why is the sky bleu".split()) and not repeats(["why"], ["why"])


def test_label_model_trusts_agreeing_votes():
    patterns = np.array(list(itertools.product([0, 1], repeat=3)))
    counts = np.array([20, 900, 3, 1, 2, 1, 40, 1])
    post = label_model(patterns, counts, [1, 1, 0])
    by = {tuple(p): v for p, v in zip(patterns, post)}
    assert by[(1, 1, 0)] > 0.9 and by[(0, 0, 1)] < 0.05


def test_cutoffs_on_spoiled_answers(spark):
    """The cutoffs are validated here: sound answers are spoiled in known ways and must be told apart."""
    rng = random.Random(3)
    subject = ["cache", "ledger", "router", "index", "queue", "meter"]
    rows, truth = [], {}
    for i in range(400):
        s, t = rng.choice(subject), rng.choice(subject)
        q = f"What does the speaker say about the {s} of the {t}?"
        a = f"The speaker says the {s} was rebuilt because the {t} kept growing. It hands the rest to the {t} after {i} rows."
        kind = rng.choice(["", "", "", "", "empty", "truncated", "refusal", "copy", "language"])
        if kind == "empty":
            a = rng.choice(["", None, "-", "N/A", "{}"])
        elif kind == "truncated":
            a = a[: rng.randrange(70, len(a) - 12)]
        elif kind == "refusal":
            a = rng.choice(["I cannot answer this question.", "No relevant information found.", "Lo siento, no puedo responder."])
        elif kind == "copy":
            a = rng.choice([q, q.upper(), f"Question: {q}"])
        elif kind == "language":
            a = f"Der {s} wurde neu gebaut, weil die {t} nicht mehr passten und die Daten zu oft fehlten."
        rows.append((i, q, a, rng.random() < 0.2, True, None))
        truth[i] = kind
    df = spark.createDataFrame(rows, "k int, q string, a string, ab boolean, ok boolean, raw string")
    found = {(r.k, r.defect) for r in defective_pairs(df, ["k"], "q", "a", "ab", "ok", "raw").collect()}
    want = {(k, d) for k, d in truth.items() if d}
    assert len(found & want) >= 0.97 * len(want) and len(found - want) <= 0.03 * len(want)
    assert defective_pairs(df.limit(0), ["k"], "q", "a", "ab", "ok", "raw").count() == 0


# --- 5 one ranking -------------------------------------------------------------------------------
def brute_flow(rows, q, p):
    lists, items = {}, {}
    for g, c, i, s, r in rows:
        if g is None or c is None or i is None or (s is None and r is None):
            continue
        lists.setdefault((g, c), {})[i] = (s, r)
        items.setdefault(g, set()).add(i)
    net = {}
    for (g, _), own in lists.items():
        pos = {i: r if s is None else sum(1 for x in own.values() if x[0] is not None and x[0] >= s) for i, (s, r) in own.items()}
        m = max(len(own), max(pos.values()))
        x = {i: (2 * 10**6 * (m - pos[i] + 1) + m) // (2 * m) if i in pos else 0 for i in items[g]}
        prefer = lambda d: max(0, min(p - q, d - q)) / (p - q)
        for a in items[g]:
            up, down = sum(prefer(x[a] - x[b]) for b in items[g]), sum(prefer(x[b] - x[a]) for b in items[g])
            n = max(1, len(items[g]) - 1)
            before = net.get((g, a), (0.0, 0.0))
            net[g, a] = (before[0] + up / n, before[1] + down / n)
    return net


@pytest.mark.parametrize("shard,q,p", [(100000, 50_000, 500_000), (4, 50_000, 500_000), (10, 0, 1_000_000), (100000, 0, 10)])
def test_net_flow_against_all_pairs(spark, shard, q, p):
    rng = random.Random(4)
    rows = []
    for g in ("q1", "q2"):
        for c, scale in (("a", 1.0), ("b", 1000.0), ("c", 1e-4)):
            ids = rng.sample(range(40), 17)
            scores = sorted((round(rng.random(), 2) * scale for _ in ids), reverse=True)
            for k, (i, s) in enumerate(zip(ids, scores)):
                rank = None if c == "c" or rng.random() < 0.1 and k else k + 1
                rows.append((g, c, i, None if rng.random() < 0.1 and rank else s, rank))
    rows += [rows[0], (None, "a", 1, 1.0, 1), ("q1", "a", None, 1.0, 1), ("q1", "a", 99, None, None)]
    df = spark.createDataFrame(rows, "g string, c string, i int, s double, r int")
    got = {(x.g, x.i): (x.positive, x.negative) for x in net_flow(df, "g", "c", "i", "s", "r", indifferent=q, preferred=p, shard_rows=shard).collect()}
    want = brute_flow(rows, q, p)
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    best = {(x.g, x.i) for x in top_items(net_flow(df, "g", "c", "i", "s", "r", indifferent=q, preferred=p, shard_rows=shard), "g", "i", 3).collect()}
    assert best == {(g, i) for g in ("q1", "q2") for i in sorted((i for h, i in want if h == g), key=lambda i: (-round(want[g, i][0] - want[g, i][1], 9), i))[:3]}
    assert net_flow(df.limit(0), "g", "c", "i", "s", "r").count() == 0


# --- 6 splitting ---------------------------------------------------------------------------------
def long_text(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.12 else "") + ("\n\n" if rng.random() < 0.02 else "") for _ in range(n))


@pytest.mark.parametrize("limit,overlap", [(50, 8), (20, 0), (3, 2), (1, 0)])
def test_pieces_cover_the_text(limit, overlap):
    text = long_text(1, 700)
    pieces, tokens = split_text(text, limit, overlap), text.split()
    fresh = []
    for first, back, n, piece in pieces:
        assert n <= limit and len(piece.split()) == n and piece in text and piece.split() == tokens[first - back : first - back + n]
        fresh += piece.split()[back:]
    assert fresh == tokens and all(p[1] == min(overlap, p[0]) for p in pieces)


def test_an_edit_alters_neighbouring_pieces_only():
    text = long_text(2, 3000)
    words = text.split(" ")
    edited = " ".join([*words[:300], "inserted", *words[300:]])
    a, b = {p[3] for p in split_text(text, 120, 0)}, {p[3] for p in split_text(edited, 120, 0)}
    assert len(b - a) <= 6 and len(a) > 30
    with_end = [p[3] for p in split_text(text, 120, 0)][:-1]
    assert sum(p.rstrip()[-1] == "." or "\n" in text[text.index(p) + len(p) : text.index(p) + len(p) + 2] for p in with_end) >= 0.95 * len(with_end)


def test_the_strongest_boundary_in_reach_cuts():
    word = lambda n: " ".join(WORDS[:n])
    ends = lambda text, limit: [p[3].rstrip()[-1] for p in split_text(text, limit, 0)][:-1]
    assert [p[3] for p in split_text(f"{word(6)}. {word(6)}\n\n{word(6)}. {word(9)}", 20, 0)][0].endswith(WORDS[5])  # the paragraph, not the sentence
    assert ends(f"{word(9)}, {word(9)}, {word(9)}, {word(9)}", 12) == [",", ",", ","]  # clauses where nothing stronger is
    assert ends(f"{word(9)}. {word(9)}, {word(9)}. {word(9)}", 24)[0] == "."


def test_no_boundaries_and_split_errors():
    assert max(p[2] for p in split_text("x " * 1000, 64, 5)) == 64
    assert split_text("a\tb\nc", 3, 1) == [(0, 0, 3, "a\tb\nc")] and token_spans(" \n\t ") == []
    with pytest.raises(ValueError):
        split_text("a b", 2, 2)


def test_split_oversized_table(spark):
    text = long_text(3, 130)
    rows = [(1, "s", text, 5, "k"), (1, "s", text, 9, "k"), (2, "s", "short one", 999, "k"), (3, "none", text, 1, "k"), (4, None, text, 1, "k"), (5, "s", None, 1, "k"), (None, "s", text, 1, "k"), (6, "o", text, 1, "k"), (7, "s", "", 1, "k")]
    items = spark.createDataFrame(rows, "id int, kind string, text string, token_count int, k string")
    limits = spark.createDataFrame([("s", 50, 10, 0), ("o", 40, 90, 0), (None, 1, 1, 0)], "kind string, m int, o int, id int")
    out = split_oversized(items, limits, "id", "kind", "text", "m", "o").collect()
    assert {r.id for r in out} == {1, 6} and max(r.tokens for r in out if r.id == 1) <= 50 and max(r.tokens for r in out if r.id == 6) <= 40
    assert len([r for r in out if r.id == 1]) == len({r.piece_no for r in out if r.id == 1})
    assert split_oversized(items.limit(0), limits, "id", "kind", "text", "m", "o").count() == 0
    assert [r[0] for r in spark.createDataFrame([("a b\tc\r\nd e",), (None,), (" ",)], "t string").select(count_tokens(F.col("t"))).collect()] == [4, 0, 0]


# --- 7 nearest in time ---------------------------------------------------------------------------
def test_nearest_against_nested_loops(spark):
    rng = random.Random(6)
    left = [(i, rng.choice(["a", "b", None]), rng.choice([None, float("nan"), round(rng.uniform(-50, 50), 1)] + [round(rng.uniform(-50, 50), 1)] * 6)) for i in range(200)]
    right = [(i, rng.choice(["a", "b", None]), rng.choice([None] + [round(rng.uniform(-60, 60), 1)] * 8)) for i in range(60)] + [(900 + i, "a", 7.0) for i in range(500)]
    left += [left[0], (999, "a", -0.0), (998, "a", 0.0)]
    got = {(r.left_id, r.right_id) for r in nearest_in_time(spark.createDataFrame(left, "fid int, v string, t double"), spark.createDataFrame(right, "cid int, v string, t double"), "fid", "v", "t", "cid", "v", "t", 3.0).collect()}
    want = set()
    for i, v, t in left:
        near = [(abs(t - u), u, j) for j, w, u in right if t is not None and t == t and v is not None and v == w and u is not None and abs(t - u) <= 3.0]
        if near:
            want.add((i, min(near)[2]))
    assert got == want
    empty = spark.createDataFrame([], "cid int, v string, t double")
    assert nearest_in_time(spark.createDataFrame(left, "fid int, v string, t double"), empty, "fid", "v", "t", "cid", "v", "t", 3.0).count() == 0


# --- 8 leaks -------------------------------------------------------------------------------------
def test_winnowing_guarantee():
    rng = random.Random(7)
    for _ in range(60):
        shared = [rng.choice(WORDS) for _ in range(12)]
        a = [rng.choice(WORDS) for _ in range(rng.randrange(30))] + shared + [rng.choice(WORDS) for _ in range(rng.randrange(30))]
        b = [rng.choice(WORDS) for _ in range(rng.randrange(30))] + shared + [rng.choice(WORDS) for _ in range(rng.randrange(30))]
        ha, hb = gram_hashes(a, 6), gram_hashes(b, 6)
        assert set(ha[winnow(ha, 7)]) & set(hb[winnow(hb, 7)])
        assert longest_common_run(a, b, ha, hb, 6)[0] >= 12
    assert len(gram_hashes(["a"], 6)) == 0 and len(winnow(np.empty(0, np.uint64), 7)) == 0


def test_markup_of_any_length_does_not_break_a_run():
    run = " ".join(WORDS[:6]) + "{}" + " ".join(WORDS[6:12])
    for between in (f'<span style="{"x" * 900}">', f" [link](https://{'y' * 2000}) ", "<!-- " + "z " * 700 + "-->", "\n12\n00:01:02.000 --> 00:01:04.000\n"):
        assert " ".join(passage_words(run.format(between))).replace("link ", "") == " ".join(WORDS[:12])
    assert passage_words("a < b and c > d") == ["a", "b", "and", "c", "d"]


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(40)), "x") for i in range(25)]
    docs = []
    for d in range(120):
        body = [rng.choice(WORDS) for _ in range(rng.randrange(5, 80))]
        if d % 3 == 0:
            src = rng.choice(items)[1].split()
            n, at = rng.choice([8, 11, 12, 20]), rng.randrange(20)
            cut = [w.upper() if k % 3 else f"<b>{w}</b>," for k, w in enumerate(src[at : at + n])]
            cut.insert(5, "\n00:00:01.000 --> 00:00:04.500\n")
            body[3:3] = cut
        docs.append((d, " ".join(body), 1))
    docs += [(1000, None, 1), (1001, "", 1), (None, items[0][1], 1), (docs[0][0], docs[0][1], 1)]
    run = lambda held: sorted(tuple(r) for r in leaked_passages(spark.createDataFrame(docs, "doc_id int, text string, i int"), spark.createDataFrame(items, "item_id int, text string, d string"), "doc_id", "text", "item_id", "text", held_chars=held).collect())
    rows = run(10**6)
    assert rows == run(0)  # items in every task, and fingerprints joined
    got = {(d, i): n for d, i, n, _ in rows}
    want = {}
    for d, t, _ in docs:
        w = passage_words(t)
        for i, s, _ in items:
            v = s.split()
            grams = {tuple(v[k : k + 12]) for k in range(len(v) - 11)}
            if d is not None and any(tuple(w[k : k + 12]) in grams for k in range(len(w) - 11)):
                want[d, i] = 1
    assert got.keys() == want.keys() and min(got.values()) >= 12
    none = spark.createDataFrame([], "item_id int, text string")
    assert leaked_passages(spark.createDataFrame(docs, "doc_id int, text string, i int"), none, "doc_id", "text", "item_id", "text").count() == 0
    with pytest.raises(ValueError):
        leaked_passages(spark.createDataFrame(docs, "doc_id int, text string, i int"), none, "doc_id", "text", "item_id", "text", 5, 6)


# --- 9 mixing ------------------------------------------------------------------------------------
def test_mix_reaches_shares_within_caps(spark):
    rng = random.Random(9)
    rows = []
    for s, n, vocab in (("a", 300, WORDS[:30]), ("b", 60, WORDS[25:55]), ("c", 12, WORDS[50:])):
        rows += [(len(rows) + k, s, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 60)))) for k in range(n)]
    rows += [(10_000 + k, "other", " ".join(rng.choice(WORDS[50:]) for _ in range(20))) for k in range(40)]
    rows += [(20_000 + k, "a", rows[0][2]) for k in range(150)] + [(30_000, None, None), (30_001, "b", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    goal = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("absent", 0.2, 9)], "source string, share double, cap int")
    mix = mix_to_targets(docs, goal, "doc_id", "text", "source", "share", "cap")
    report = {r.source: r for r in mix.report.collect()}
    assert report["absent"].reached_share == 0 and abs(sum(r.reached_share for r in report.values()) - 1) < 1e-6
    for s, share in (("a", 0.375), ("b", 0.375), ("c", 0.25)):
        assert report[s].planned_share == pytest.approx(share) and abs(report[s].reached_share - share) < 0.02
    # soft members go where their words belong
    assert report["c"].soft_tokens > 0.5 * sum(r.soft_tokens for r in report.values())
    copies = {r.doc_id: r.copies for r in mix.documents.collect()}
    assert len(copies) == len({r[0] for r in rows})
    assert all(copies[i] <= {"a": 1, "b": 2, "c": 4}.get(s, 4) for i, s, _ in rows)
    assert sum(copies[20_000 + k] for k in range(150)) == 0 and copies[30_000] == copies[30_001] == 0
    big = mix_to_targets(docs, goal, "doc_id", "text", "source", "share", "cap", total_tokens=10**9).report.collect()
    assert {r.source: r.most_copies for r in big} == {"a": 1, "b": 2, "c": 4, "absent": 0}
    assert mix_to_targets(docs, goal.limit(0), "doc_id", "text", "source", "share", "cap").documents.filter("copies > 0").count() == 0
    assert mix_to_targets(docs.limit(0), goal, "doc_id", "text", "source", "share", "cap").report.count() == 4


def test_membership_is_the_whole_posterior():
    flat, base = np.full(10, 0.1), np.arange(1.0, 11) / 55
    assert np.allclose(mixing.membership(flat, base, -1), flat)
    rare = np.array([0.9] + [0.1 / 9] * 9)
    assert np.allclose(mixing.membership(rare, base, -1), rare)
    marked = rare / base * np.where(np.arange(10) == 4, mixing.LABEL_PRIOR, (1 - mixing.LABEL_PRIOR) / 9)
    assert np.allclose(mixing.membership(rare, base, 4), marked / marked.sum()) and (marked > 0).all()


def test_mix_spreads_soft_members_over_all_sources(spark, monkeypatch):
    rng = random.Random(19)
    names = "abcdef"
    rows = [(len(names) * k + i, s, " ".join(rng.choice(WORDS[10 * i : 10 * i + 12]) for _ in range(30))) for i, s in enumerate(names) for k in range(60)]
    # words of all six sources alike
    rows += [(10_000 + k, None, " ".join(rng.choice(WORDS[10 * i : 10 * i + 10]) for i in range(6) for _ in range(5))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    goal = spark.createDataFrame([(s, 1 / 6, 2) for s in names], "source string, share double, cap int")

    def mixed():
        mix = mix_to_targets(docs, goal, "doc_id", "text", "source", "share", "cap")
        return mix.report.collect(), {r.doc_id: r.copies for r in mix.documents.collect()}

    report, copies = mixed()
    soft = sum(copies[10_000 + k] for k in range(60))
    assert soft > 0 and all(r.soft_tokens > 0.05 * sum(x.soft_tokens for x in report) for r in report)
    assert all(abs(r.reached_share - 1 / 6) < 0.01 and r.residual <= 1e-5 for r in report)
    # not less than the labelled texts alone give, and every text within its cap
    assert sum(r.mixed_tokens + r.soft_tokens for r in report) > 0.95 * 2 * 6 * min(r.available_tokens for r in report) and max(copies.values()) <= 2
    # the rounds as distributed sums, in small slices
    monkeypatch.setattr(mixing, "HELD_TEXTS", 0)
    monkeypatch.setattr(mixing, "SLICE_CELLS", 100)
    again, others = mixed()
    assert others == copies and [r.rounds for r in again] == [r.rounds for r in report]


# --- 10 personal details -------------------------------------------------------------------------
def test_checksums():
    assert luhn("79927398713") and not luhn("79927398710") and mod97("GB82WEST12345698765432") and not mod97("GB82WEST12345698765431")
    assert mod11_10("86095742719") and spanish("12345678Z") and spanish("X1234567L") and not spanish("12345678A")


def test_details():
    seeds = Seeds(frozenset({"maren", "zoë"}))
    text = (
        "Contact: Dr. Maren van Dorick-Hale <maren.d@mail.example>\nYou can reach me at +1 345 555 0130 after the session.\nMy passport number is ZZ7380822.\n"
        "I live at 49B Ithwater Crescent now. The Iris Board demo sits beside package router@4.2.1, run 0042-1187 and rows 1000-2000-3000.\n"
        "As O'LORNE, Zoë told me over lunch. Write to x.y at post dot example dot org. Die Post geht an Kerrmoorallee 60, 73097 Brack."
    )
    found = {(f.kind, text[f.start : f.end]) for f in details(text, seeds)}
    assert found == {
        ("name", "Maren van Dorick-Hale"), ("email", "maren.d@mail.example"), ("phone", "+1 345 555 0130"), ("id_number", "ZZ7380822"), ("address", "49B Ithwater Crescent"),
        ("name", "O'LORNE, Zoë"), ("email", "x.y at post dot example dot org"), ("address", "Kerrmoorallee 60"),
    }
    clean = redact(text, details(text, seeds))
    assert clean.startswith("Contact: Dr. [NAME] <[EMAIL]>") and "[PHONE] after the session" in clean
    assert details(None, seeds) == [] and details("", seeds) == [] and redact(None, []) is None


def test_whole_names_long_addresses_and_strict_checksums():
    seeds = Seeds(frozenset({"maren"}))
    found = lambda text: {(f.kind, text[f.start : f.end]) for f in details(text, seeds)}
    assert found("Ana Maria Luz Pilar Isabel Carmen Garcia lives at home.") == {("name", "Ana Maria Luz Pilar Isabel Carmen Garcia")}
    assert found("We met. maria de la luz garcia fernandez lopez lives at home.") == {("name", "maria de la luz garcia fernandez lopez")}
    assert found("Then Tuesday Maren Luz van Dorick told me so.") == {("name", "Maren Luz van Dorick")} and found("As Lena Dorick told me so.") == {("name", "Lena Dorick")}
    domain = ".".join(ch * 61 for ch in "abcd") + ".info"
    assert len(domain) == 252 and found(f"mail x.y@{domain} now") == {("email", f"x.y@{domain}")}
    spelled = "x at " + "averyverylonglabel dot " * 20 + "org"
    assert found(f"write {spelled}, please") == {("email", spelled)}
    # account, card and social insurance numbers need their checksum; numbers without one need a word beside them
    assert found("passport GB82 WEST 1234 5698 7654 31") == set() and found("ID 4111 1111 1111 1112") == set() and found("ID 4111 1111 1111 1111") == {("id_number", "4111 1111 1111 1111")}
    assert found("tax id GB82 WEST 1234 5698 7654 32") == {("id_number", "GB82 WEST 1234 5698 7654 32")} and found("build 123-45-6789") == set()


def test_personal_details_table(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.example " + "filler words here " * 30000, 7), (2, None, 7), (3, "", 7), (None, "x@y.example", 7), (4, "same@y.example same@y.example", 7)], "doc_id int, text string, found int")
    out = {r.doc_id: r for r in personal_details(docs, "doc_id", "text").collect()}
    assert [f.value for f in out[1].found] == ["a.b@c.example"] and out[2].redacted is None and out[3].found == [] and len(out[None].found) == 1 and len(out[4].found) == 2
    assert personal_details(docs.limit(0), "doc_id", "text").count() == 0
