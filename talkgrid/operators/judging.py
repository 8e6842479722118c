"""Model output read strictly: answers, judges' scores, plans, and the alignment of judged claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkgrid.operators.answering import first_object, strip_fence


def kind_at(v: Column, path: str) -> Column:
    """Type of the value at a path of a variant: null where there is none, ``VOID`` for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def salvaged(raw: Column) -> Column:
    """The JSON of a text, or of the one code fence around it."""
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(strip_fence(raw)))


def _first_error(rules: list[tuple[Column, str]]) -> Column:
    return reduce(lambda rest, rule: F.when(rule[0], rule[1]).otherwise(rest), reversed(rules), F.lit(None).cast("string"))


def generation(raw: Column) -> Column:
    """Struct (parse_ok, error, answer, abstain, claims, citations) of a model's answer.

    The text is parsed as it is, else without one code fence; anything but an object, or a field of another type
    than declared, is an error.  Missing fields take their defaults.  A failed parse has null fields.
    """
    v = salvaged(raw)
    kind = lambda path: kind_at(v, path)
    wrong = lambda path, ok: kind(path).isNotNull() & ~kind(path).rlike(ok)
    claims = F.try_variant_get(v, "$.claims", "array<variant>")
    cites = F.try_variant_get(v, "$.citations", "array<variant>")
    text = lambda c: F.coalesce(F.schema_of_variant(F.try_variant_get(c, "$.text", "variant")) == "STRING", F.lit(False)) & (F.length(F.try_variant_get(c, "$.text", "string")) > 0)
    number = lambda c, path: F.try_variant_get(c, path, "double")
    cited = lambda c: F.coalesce(
        (F.schema_of_variant(F.try_variant_get(c, "$.video_id", "variant")) == "STRING") & (number(c, "$.start_sec") >= 0) & (number(c, "$.end_sec") > 0) & (number(c, "$.answer_claim_index") >= 0), F.lit(False)
    )
    error = _first_error(
        [
            (v.isNull(), "json"), (~F.schema_of_variant(v).startswith("OBJECT"), "not an object"), (wrong("$.answer", "^STRING$"), "answer"), (wrong("$.claims", "^ARRAY"), "claims"),
            (F.exists(claims, lambda c: ~text(c)), "claims"), (wrong("$.citations", "^ARRAY"), "citations"), (F.exists(cites, lambda c: ~cited(c)), "citations"), (wrong("$.abstain", "^BOOLEAN$"), "abstain"),
        ]
    )
    ok = error.isNull()
    size = lambda a: F.when(ok, F.coalesce(F.array_size(a), F.lit(0)))
    return F.struct(
        ok.alias("parse_ok"), error.alias("error"), F.when(ok, F.coalesce(F.try_variant_get(v, "$.answer", "string"), F.lit(""))).alias("answer"),
        F.when(ok, F.coalesce(F.try_variant_get(v, "$.abstain", "boolean"), F.lit(False))).alias("abstain"), size(claims).alias("claims"), size(cites).alias("citations"),
    )


def judged(raw: Column, path: str = "$.confidence", refined: str = "$.refined_query", default: float = 0.5) -> Column:
    """Struct (confidence, refined, failed) of a judge's JSON: clamped to [0, 1], the default where it cannot be read; blank rewrites are null."""
    v = F.try_parse_json(raw)
    bad = v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT")
    conf = F.try_variant_get(v, path, "double")
    failed = bad | (kind_at(v, path).isNotNull() & conf.isNull())
    text = F.when(kind_at(v, refined) == "STRING", F.trim(F.try_variant_get(v, refined, "string")))
    return F.struct(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(failed, F.lit(default)).otherwise(F.coalesce(conf, F.lit(default))))).alias("confidence"), F.when(~failed & (text != ""), text).alias("refined"), failed.alias("failed")
    )


def whole_score(raw: Column, key: str, low: int = 1, high: int = 5) -> Column:
    """A whole number from ``low`` to ``high`` under a key of the first JSON object of a text; booleans, fractions and strings are null."""
    v = F.try_parse_json(first_object(raw))
    n = F.when(kind_at(v, f"$.{key}").isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.try_variant_get(v, f"$.{key}", "bigint"))
    return F.when(n.between(low, high), n.cast("int"))


def plan(raw: Column) -> Column:
    """Struct (question_type, sub_queries, error) of a planner's JSON, checked for kind and types."""
    v = F.try_parse_json(raw)
    kind = F.when(kind_at(v, "$.question_type") == "STRING", F.try_variant_get(v, "$.question_type", "string"))
    subs = F.try_variant_get(v, "$.sub_queries", "array<variant>")
    fine = lambda s: (F.schema_of_variant(s) == "STRING") & (F.length(F.try_variant_get(s, "$", "string")) > 0)
    error = _first_error([(v.isNull(), "json"), (~F.coalesce(kind.isin("single_clip", "synthesis"), F.lit(False)), "bad question_type"), (subs.isNull() | F.exists(subs, lambda s: ~F.coalesce(fine(s), F.lit(False))), "bad sub_queries")])
    return F.struct(F.when(error.isNull(), kind).alias("question_type"), F.when(error.isNull(), F.transform(subs, lambda s: F.try_variant_get(s, "$", "string"))).alias("sub_queries"), error.alias("error"))
