"""Queries that read model output and judgements, and the states of claimed steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrid.operators import fusion, judging, steps
from talkgrid.operators.answering import aligned_flags
from talkgrid.plans.metrics import _ANSWERS_SQL
from talkgrid.plans.registry import Registry
from talkgrid.tables import once, table

R = Registry()


@R.query(
    f"WITH {_ANSWERS_SQL}, s AS (SELECT run_id, example_id, raw_response AS raw, CASE WHEN regexp_matches(raw_response, '(?is)^\\s*```(json)?\\s*.*\\S.*```\\s*$') THEN regexp_extract(raw_response, '(?is)^\\s*```(?:json)?\\s*(.*?)\\s*```\\s*$', 1) END AS inner_text FROM p WHERE raw_response IS NOT NULL),"
    + """ j AS (SELECT *, coalesce(CASE WHEN NOT regexp_matches(raw, ',\\s*[}\\]]') THEN try_cast(raw AS JSON) END, CASE WHEN NOT regexp_matches(inner_text, ',\\s*[}\\]]') THEN try_cast(inner_text AS JSON) END) AS d FROM s),
e AS (SELECT *, CASE WHEN d IS NULL THEN 'json' WHEN json_type(d) <> 'OBJECT' THEN 'not an object' WHEN json_type(d, '$.answer') <> 'VARCHAR' THEN 'answer' WHEN json_type(d, '$.claims') <> 'ARRAY' THEN 'claims'
  WHEN len(list_filter(CAST(d->'$.claims' AS JSON[]), lambda c: coalesce(json_type(c, '$.text'), '') <> 'VARCHAR' OR json_extract_string(c, '$.text') = '')) > 0 THEN 'claims'
  WHEN json_type(d, '$.citations') <> 'ARRAY' THEN 'citations'
  WHEN len(list_filter(CAST(d->'$.citations' AS JSON[]), lambda c: NOT coalesce(json_type(c, '$.video_id') = 'VARCHAR' AND CAST(c->>'$.start_sec' AS DOUBLE) >= 0 AND CAST(c->>'$.end_sec' AS DOUBLE) > 0 AND CAST(c->>'$.answer_claim_index' AS DOUBLE) >= 0, false))) > 0 THEN 'citations'
  WHEN json_type(d, '$.abstain') <> 'BOOLEAN' THEN 'abstain' END AS error FROM j)
SELECT run_id, example_id, error IS NULL AS parse_ok, error, CASE WHEN error IS NULL THEN coalesce(json_extract_string(d, '$.answer'), '') END AS answer, CASE WHEN error IS NULL THEN coalesce(CAST(d->>'$.abstain' AS BOOLEAN), false) END AS abstain,
  CASE WHEN error IS NULL THEN CAST(coalesce(json_array_length(d, '$.claims'), 0) AS INT) END AS claims, CASE WHEN error IS NULL THEN CAST(coalesce(json_array_length(d, '$.citations'), 0) AS INT) END AS citations FROM e"""
)
def generation_output(spark, directory) -> DataFrame:
    """JSN-01, STR-13: model output with one salvage, an object check, typed fields and the reason of a failure."""
    a = once(table(spark, directory, "per_example"), ["run_id", "example_id"]).filter("raw_response IS NOT NULL")
    return a.select("run_id", "example_id", judging.generation(F.col("raw_response")).alias("g")).select("run_id", "example_id", "g.*")


@R.query(
    f"WITH {_ANSWERS_SQL}, j AS (SELECT run_id, example_id, TRY_CAST(metrics AS JSON) AS d FROM p WHERE metrics IS NOT NULL), c AS (SELECT *, TRY_CAST(json_extract_string(d, '$.claims_grounded_frac') AS DOUBLE) AS v FROM j)"
    + """SELECT run_id, example_id, greatest(0.0, least(1.0, coalesce(v, 0.5))) AS confidence, d IS NULL OR (json_type(d, '$.claims_grounded_frac') IS NOT NULL AND v IS NULL) AS failed FROM c"""
)
def judge_confidence(spark, directory) -> DataFrame:
    """JSN-02, MTH-03: confidence of a judgement in JSON, clamped, one half where it cannot be read."""
    a = once(table(spark, directory, "per_example"), ["run_id", "example_id"]).filter("metrics IS NOT NULL")
    return a.select("run_id", "example_id", judging.judged(F.col("metrics"), "$.claims_grounded_frac").alias("j")).select("run_id", "example_id", "j.confidence", "j.failed")


@R.query(
    f"WITH {_ANSWERS_SQL}, g AS (SELECT id, claims FROM (SELECT id, expected_claims AS claims, row_number() OVER (PARTITION BY id ORDER BY expected_claims) AS n FROM dev_gold WHERE len(expected_claims) > 0) WHERE n = 1),"
    + """ c AS (SELECT run_id, example_id, unnest(range(len(claims))) AS position, unnest(claims) AS claim, answer FROM p JOIN g ON g.id = p.example_id WHERE answer IS NOT NULL)
SELECT run_id, example_id, CAST(position AS INT) AS position, contains(answer, claim) AND position % 3 <> 2 AS grounded FROM c"""
)
def aligned_claims(spark, directory) -> DataFrame:
    """JSN-03: judged claims by declared index; a claim judged out of range counts for none, one judged with a string is not true."""
    p = once(table(spark, directory, "per_example"), ["run_id", "example_id"]).filter("answer IS NOT NULL")
    g = once(table(spark, directory, "dev_gold").filter("size(expected_claims) > 0").select(F.col("id").alias("example_id"), "expected_claims"), ["example_id"])
    both = p.join(g, "example_id").withColumn("n", F.size("expected_claims"))
    # judgements as a model writes them: every third verdict a string, and one entry out of range
    said = F.transform("expected_claims", lambda c, i: F.concat(F.lit('{"index": '), i.cast("string"), F.lit(', "grounded": '), F.when(i % 3 == 2, '"true"').otherwise(F.contains(F.col("answer"), c).cast("string")), F.lit("}")))
    raw = F.concat(F.lit('{"claims": ['), F.array_join(said, ", "), F.lit(', {"index": 999, "grounded": true}]}'))
    rows = both.select(F.struct("run_id", "example_id").alias("key"), raw.alias("raw"), "n")
    return aligned_flags(rows, "key", "raw", "n").select("key.run_id", "key.example_id", "position", "grounded")


@R.query(
    """WITH q AS (SELECT DISTINCT id, question, question_type FROM dev_gold WHERE question IS NOT NULL)
SELECT id, CASE WHEN question_type IN ('single_clip', 'synthesis') AND question <> '' THEN question_type END AS question_type, CASE WHEN question_type IN ('single_clip', 'synthesis') AND question <> '' THEN 2 END AS sub_queries,
  CASE WHEN question_type IS NULL OR question_type NOT IN ('single_clip', 'synthesis') THEN 'bad question_type' WHEN question = '' THEN 'bad sub_queries' END AS error FROM q"""
)
def planner_output(spark, directory) -> DataFrame:
    """JSN-05, LOP-01: plans in JSON, their kind and sub-queries checked."""
    q = table(spark, directory, "dev_gold").filter("question IS NOT NULL").select("id", "question", "question_type").distinct()
    raw = F.to_json(F.struct("question_type", F.array("question", F.upper("question")).alias("sub_queries")))
    return q.select("id", judging.plan(raw).alias("p")).select("id", "p.question_type", F.array_size("p.sub_queries").alias("sub_queries"), "p.error")


_RATED_SQL = """SELECT CASE difficulty WHEN 'easy' THEN 1 WHEN 'medium' THEN 3 WHEN 'hard' THEN 5 END AS x, CAST(1 + floor(4 * f) AS INT) AS y
FROM (SELECT example_id, TRY_CAST(json_extract_string(metrics, '$.claims_grounded_frac') AS DOUBLE) AS f FROM p) JOIN (SELECT id, min(difficulty) AS difficulty FROM dev_gold GROUP BY id) g ON g.id = example_id WHERE f IS NOT NULL AND difficulty IS NOT NULL"""


def _kappa_sql(rated: str, cost: str, name: str) -> str:
    return f"""(WITH z AS ({rated}), c AS (SELECT x, y, count(*) AS n FROM z GROUP BY ALL), rx AS (SELECT x, sum(n) AS n FROM c GROUP BY x), cy AS (SELECT y, sum(n) AS n FROM c GROUP BY y), s AS (SELECT sum(n) AS t FROM c),
e AS (SELECT sum({cost} * rx.n * cy.n / t) AS e FROM rx, cy, s), o AS (SELECT sum({cost} * n) AS o FROM c)
SELECT '{name}' AS weights, CAST(t AS BIGINT) AS n, round(CASE WHEN e = 0 THEN 0 ELSE 1 - o / e END, 3) AS kappa FROM e, o, s)"""


@R.query(
    f"WITH {_ANSWERS_SQL}, r AS ({_RATED_SQL}) SELECT * FROM "
    + " UNION ALL SELECT * FROM ".join([_kappa_sql("SELECT x, y FROM r", "(abs(x - y) / 4.0)", "linear"), _kappa_sql("SELECT x, y FROM r", "(abs(x - y) / 4.0 * abs(x - y) / 4.0)", "quadratic"), _kappa_sql("SELECT CAST(x >= 4 AS INT) AS x, CAST(y >= 4 AS INT) AS y FROM r", "(CASE WHEN x <> y THEN 1.0 ELSE 0.0 END)", "binarized")])
)
def kappa_set(spark, directory) -> DataFrame:
    """AGG-22, AGG-23, JSN-04, MTH-02: agreement of two ratings from 1 to 5, linear, quadratic, and of both at least 4."""
    p = once(table(spark, directory, "per_example"), ["run_id", "example_id"]).filter("metrics IS NOT NULL")
    frac = F.try_variant_get(F.try_parse_json("metrics"), "$.claims_grounded_frac", "double")
    raw = F.to_json(F.struct((F.floor(frac * 4) + 1).alias("standalone")))
    gold = table(spark, directory, "dev_gold").groupBy(F.col("id").alias("example_id")).agg(F.min("difficulty").alias("d"))
    label = F.when(F.col("d") == "easy", 1).when(F.col("d") == "medium", 3).when(F.col("d") == "hard", 5)
    rated = p.join(gold, "example_id").select(label.alias("x"), judging.whole_score(raw, "standalone").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    counts = rated.groupBy("x", "y").agg(F.count("*").alias("n"))
    return fusion.kappa_set(counts)


_ACTION = {"signup": "enqueue", "view": "claim", "click": "complete", "error": "fail", "purchase": "skip"}
_STEPS_SQL = """WITH RECURSIVE a AS (SELECT user_id, date_trunc('day', ts) AS day, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'complete' WHEN 'error' THEN 'fail' ELSE 'skip' END AS a,
  row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT user_id, day, CAST(0 AS BIGINT) AS n, 'missing' AS s, 0 AS attempts, 0 AS acks, 0 AS violations FROM a WHERE n = 1
 UNION ALL SELECT f.user_id, f.day, a.n, CASE WHEN a = 'enqueue' AND s = 'missing' THEN 'pending' WHEN a = 'claim' AND s IN ('pending', 'in_progress', 'failed') THEN 'in_progress' WHEN a = 'complete' AND s = 'in_progress' THEN 'completed'
   WHEN a = 'fail' AND s = 'in_progress' THEN 'failed' WHEN a = 'skip' AND s = 'pending' THEN 'skipped' ELSE s END,
   attempts + CASE WHEN a = 'claim' AND s IN ('pending', 'in_progress', 'failed') THEN 1 ELSE 0 END, acks + CASE WHEN a = 'claim' AND s IN ('completed', 'skipped') THEN 1 ELSE 0 END,
   violations + CASE WHEN (a = 'claim' AND s = 'missing') OR (a IN ('complete', 'fail') AND s <> 'in_progress') THEN 1 ELSE 0 END
 FROM f JOIN a ON a.user_id = f.user_id AND a.day = f.day AND a.n = f.n + 1),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY n DESC) AS r FROM f), st AS (SELECT user_id, day, s AS state, attempts, acks, violations FROM l WHERE r = 1)
"""


def _steps(spark, directory) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for kv in _ACTION.items() for x in kv])
    e = table(spark, directory, "events").select("user_id", F.date_trunc("day", "ts").alias("day"), "ts", "event_id", kinds[F.col("event_type")].alias("action"))
    return steps.fold_steps(e, ["user_id", "day"], "action", ["ts", "event_id"])


@R.query(_STEPS_SQL + "SELECT * FROM st")
def claimed_steps(spark, directory) -> DataFrame:
    """STM-03, STM-04, SNK-10: state of every (user, day) step after its events as actions, with attempts, acknowledged claims and broken contracts."""
    return _steps(spark, directory)


@R.query(_STEPS_SQL + "SELECT user_id, day, attempts FROM st WHERE state = 'failed' AND attempts >= 3")
def dead_steps(spark, directory) -> DataFrame:
    """STM-09: failed steps tried three times or more."""
    return steps.dead_letters(_steps(spark, directory)).select("user_id", "day", "attempts")


@R.query(_STEPS_SQL + "SELECT user_id, count(*) AS expected, count(*) FILTER (state = 'completed') AS done, count(*) = count(*) FILTER (state = 'completed') AS complete FROM st GROUP BY user_id")
def fan_out_progress(spark, directory) -> DataFrame:
    """AGG-36: per user the steps expected and done."""
    return steps.fan_out_done(_steps(spark, directory), ["user_id"])
