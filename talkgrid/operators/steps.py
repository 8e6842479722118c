"""Steps that workers claim: a state per key, folded from the actions upon it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attempts from which a failed step goes to the dead letters.
MAX_ATTEMPTS = 3
STATE = "state string, attempts int, acks int, violations int"


def transition(state: Column, action: Column) -> Column:
    """The state after an action.

    ``enqueue`` makes a missing step pending; ``claim`` starts any step that is not completed or skipped,
    again as well; ``complete`` and ``fail`` end a step in progress only; ``skip`` ends a pending one.
    Anything else leaves the state.
    """
    return (
        F.when((action == "enqueue") & (state == "missing"), "pending")
        .when((action == "claim") & state.isin("pending", "in_progress", "failed"), "in_progress")
        .when((action == "complete") & (state == "in_progress"), "completed")
        .when((action == "fail") & (state == "in_progress"), "failed")
        .when((action == "skip") & (state == "pending"), "skipped")
        .otherwise(state)
    )


def fold_steps(actions: DataFrame, keys: list[str], action: str, order: list[str]) -> DataFrame:
    """State of every key after all its actions in order: keys, state, attempts, acks, violations.

    A claim of a completed or skipped step is only acknowledged; a claim of a missing one, and an end of a
    step that is not in progress, break the contract and are counted.  A key's actions lie in one row; a
    step is claimed a few times, so they are few.
    """
    own = actions.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(action).alias("a")))), lambda x: x["a"]).alias("acts"))
    start = F.struct(F.lit("missing").alias("state"), F.lit(0).alias("attempts"), F.lit(0).alias("acks"), F.lit(0).alias("violations"))

    def step(acc, a):
        state = acc["state"]
        claimed = (a == "claim") & state.isin("pending", "in_progress", "failed")
        ack = (a == "claim") & state.isin("completed", "skipped")
        broken = ((a == "claim") & (state == "missing")) | (a.isin("complete", "fail") & (state != "in_progress"))
        plus = lambda name, when: (acc[name] + F.when(when, 1).otherwise(0)).alias(name)
        return F.struct(transition(state, a).alias("state"), plus("attempts", claimed), plus("acks", ack), plus("violations", broken))

    return own.select(*keys, F.aggregate("acts", start, step).alias("s")).select(*keys, "s.*")


def dead_letters(steps: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Failed steps that were tried often enough."""
    return steps.filter((F.col("state") == "failed") & (F.col("attempts") >= most))


def fan_out_done(steps: DataFrame, parent: list[str]) -> DataFrame:
    """Per parent: children expected and completed, and whether all of at least one are."""
    per = steps.groupBy(*parent).agg(F.count("*").alias("expected"), F.count(F.when(F.col("state") == "completed", 1)).alias("done"))
    return per.withColumn("complete", (F.col("expected") > 0) & (F.col("expected") == F.col("done")))


_NEXT = {
    ("missing", "enqueue"): "pending", ("pending", "claim"): "in_progress", ("in_progress", "claim"): "in_progress", ("failed", "claim"): "in_progress",
    ("in_progress", "complete"): "completed", ("in_progress", "fail"): "failed", ("pending", "skip"): "skipped",
}


def stream_steps(actions: DataFrame, key: str, action: str, order: str) -> DataFrame:
    """The same on a stream, with the state kept per key: key, state, attempts, acks, violations after every batch.

    Actions of one micro-batch are taken in order; a replayed batch finds the state before it.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        state, attempts, acks, violations = kept.get if kept.exists else ("missing", 0, 0, 0)
        for a in pd.concat(list(batches)).sort_values("o", kind="stable").a:
            if a == "claim":
                if state in ("completed", "skipped"):
                    acks += 1
                elif state == "missing":
                    violations += 1
                else:
                    attempts += 1
            elif a in ("complete", "fail") and state != "in_progress":
                violations += 1
            state = _NEXT.get((state, a), state)
        kept.update((state, attempts, acks, violations))
        yield pd.DataFrame([(k[0], state, attempts, acks, violations)], columns=["k", "state", "attempts", "acks", "violations"])

    rows = actions.select(F.col(key).cast("string").alias("k"), F.col(action).alias("a"), F.col(order).alias("o"))
    return rows.groupBy("k").applyInPandasWithState(run, f"k string, {STATE}", STATE, "update", "NoTimeout")
