"""A queue of rows over rounds: answers are judged, repaired within a budget, and replaced where a model failed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import save

Step = Callable[[DataFrame], DataFrame]
APPROVED, EXHAUSTED, FALLBACK, DEFERRED = "approved", "exhausted", "fallback", "deferred"


def run_rounds(rows: DataFrame, key: str, answer: Step, judge: Step, repair: Step, fallback: Step, budget: int = 2, write=None) -> tuple[DataFrame, DataFrame]:
    """(results, states). results: what answer() gives for each key, from the row's last round; states: key, round, state, error.

    answer and fallback take rows; repair takes rows with the columns of the last answer and `hint`; all three give key, the same
    further columns, and a nullable `error`. judge takes answers and gives key, approved and hint (any type; null if approved).
    Each round an answer with an error is replaced by fallback's and done; an approved one is done; of the others those that
    have been judged `budget` times are done as they are, exhausted, the rest is repaired in the next round. A round is one table, written
    once, and what is open is what no earlier round has finished (an anti-join), so a run that lost its driver can read on from
    the tables. Rounds are bounded by the budget, never by rows. write(table, name) keeps a table; by default in the shared folder.
    """
    write = write or save
    rows = write(rows, "queue")
    states: DataFrame | None = None
    results: DataFrame | None = None
    todo = rows
    for n in range(1, max(budget, 1) + 1):
        given = write(answer(todo) if n == 1 else repair(todo), f"answers_{n}")
        good = given.where("error is null").drop("error")
        judged = good.join(judge(good).select(key, "approved", "hint"), key, "left")
        state = F.when(F.coalesce("approved", F.lit(False)), APPROVED).when(F.lit(n >= budget), EXHAUSTED).otherwise(DEFERRED)
        failed = given.where("error is not null").select(key, "error")
        instead = fallback(rows.join(failed, key, "left_semi")).drop("error").join(failed, key)
        table = judged.select(*good.columns, "hint", F.lit(None).cast("string").alias("error"), state.alias("state")).unionByName(
            instead.select(*good.columns, F.lit(None).cast(judged.schema["hint"].dataType).alias("hint"), F.col("error").cast("string").alias("error"), F.lit(FALLBACK).alias("state"))
        )
        table = write(table.withColumn("round", F.lit(n)), f"round_{n}")
        step = table.select(key, "round", "state", "error")
        states = step if states is None else states.unionByName(step)
        done = table.where(F.col("state") != DEFERRED).drop("hint", "state", "round", "error")
        results = done if results is None else results.unionByName(done)
        open_ = rows.join(states.where(F.col("state") != DEFERRED).select(key), key, "left_anti")
        last = table.where(F.col("state") == DEFERRED).select(key, *(c for c in good.columns if c != key and c not in rows.columns), "hint")
        todo = open_.join(last, key)
        if n >= budget or todo.isEmpty():
            break
    return results, states


def last_states(states: DataFrame, key: str) -> DataFrame:
    """key, rounds, state, error: how each row ended, and after how many rounds."""
    last = F.max(F.struct("round", "state", "error")).alias("s")
    return states.groupBy(key).agg(last).select(key, F.col("s.round").alias("rounds"), F.col("s.state").alias("state"), F.col("s.error").alias("error"))


def extraction_rounds(reviews: DataFrame, classical: Step, validate: Step, repair: Step, least: float = 0.5, sure: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Hybrid extraction of reviews (review_id, text): (triples, states).

    classical: review_id, text to review_id, triples (array of structs with a confidence). Where all of a review's triples are
    sure of themselves, validate sees them alone (fast), else with the text; it gives review_id, triples, needs_repair, missing
    and error. A review that needs repair, or has no triples at all, goes to repair once, with `missing` as its hint; where a
    model fails, the classical triples stand. Triples below `least` are dropped.
    """
    first = save(reviews.join(classical(reviews).select("review_id", F.col("triples").alias("candidates")), "review_id"), "classical")
    fast = (F.size("candidates") > 0) & F.forall("candidates", lambda t: t["confidence"] >= sure)

    def answer(rows: DataFrame) -> DataFrame:
        asked = rows.withColumn("fast", fast).withColumn("text", F.when(~fast, F.col("text")))
        return validate(asked).select("review_id", "triples", "needs_repair", "missing", "error")

    def judge(given: DataFrame) -> DataFrame:
        rows = given.join(first.select("review_id", F.size("candidates").alias("_n")), "review_id")
        bad = F.coalesce("needs_repair", F.lit(False)) | ((F.size("triples") == 0) & (F.col("_n") == 0))
        return rows.select("review_id", (~bad).alias("approved"), F.when(bad, F.coalesce("missing", F.lit(""))).alias("hint"))

    def mended(rows: DataFrame) -> DataFrame:
        out = repair(rows.select("review_id", "text", "candidates", "hint"))
        return out.select("review_id", "triples", F.lit(False).alias("needs_repair"), F.lit(None).cast("string").alias("missing"), "error")

    def stand(rows: DataFrame) -> DataFrame:
        return rows.select("review_id", F.col("candidates").alias("triples"), F.lit(False).alias("needs_repair"), F.lit(None).cast("string").alias("missing"), F.lit(None).cast("string").alias("error"))

    found, states = run_rounds(first, "review_id", answer, judge, mended, stand, budget=2)
    return found.select("review_id", F.filter("triples", lambda t: t["confidence"] >= least).alias("triples")), states
