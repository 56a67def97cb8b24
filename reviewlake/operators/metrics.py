"""Ranking metrics, their aggregation over users, and tests between two runs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import save


def ideal_dcg(n: Column, k: int) -> Column:
    """Discounted gain of min(n, k) hits in the first places."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(k))).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))


def rank_metrics(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10, 20), unit: str = "user_id") -> DataFrame:
    """A row per unit of relevant (unit, item), with hr, recall, ndcg and mrr at each k. Units without hits have zeros.

    ranked: unit, item, rank. Only hits are joined, in one shuffle by unit and item, and all metrics are one aggregation.
    """
    if min(ks) < 1:
        raise ValueError("k must be at least 1")
    goal = relevant.select(unit, "item").distinct()
    hits = goal.join(ranked.where(F.col("rank") <= max(ks)).select(unit, "item", "rank"), [unit, "item"], "left")
    aggs = [F.count("*").alias("n_relevant")]
    for k in ks:
        inside = F.col("rank") <= k
        aggs += [
            F.max(F.when(inside, 1.0).otherwise(0.0)).alias(f"hr_{k}"), F.count_if(inside).alias(f"_hits_{k}"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + F.lit(1.0))).otherwise(0.0)).alias(f"_dcg_{k}"),
            F.coalesce(1 / F.min(F.when(inside, F.col("rank"))), F.lit(0.0)).alias(f"mrr_{k}"),
        ]
    out = hits.groupBy(unit).agg(*aggs)
    for k in ks:
        out = out.withColumn(f"recall_{k}", F.col(f"_hits_{k}") / F.col("n_relevant")).withColumn(f"ndcg_{k}", F.col(f"_dcg_{k}") / ideal_dcg(F.col("n_relevant"), k))
    return out.drop(*(c for k in ks for c in (f"_hits_{k}", f"_dcg_{k}")))


def single_rank_metrics(rank: Column, ks: tuple[int, ...] = (10, 20)) -> list[Column]:
    """The metrics of one relevant item by its place; null: not found."""
    out = []
    for k in ks:
        hit = F.coalesce(rank <= k, F.lit(False))
        out += [hit.cast("double").alias(f"hr_{k}"), F.when(hit, 1 / F.log2(rank + F.lit(1.0))).otherwise(0.0).alias(f"ndcg_{k}"), F.when(hit, 1 / rank).otherwise(0.0).alias(f"mrr_{k}")]
    return out


def mean_hr(metrics: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    return metrics.withColumn("avg_hr", sum((F.col(f"hr_{k}") for k in ks), F.lit(0.0)) / len(ks))


def long_form(metrics: DataFrame, names: list[str], unit: str = "user_id") -> DataFrame:
    return metrics.unpivot([unit], names, "metric", "value")


def means(long: DataFrame, by_user: bool = True, user: str = "user_id") -> DataFrame:
    """metric, mean: over rows, or over users of their own means."""
    if by_user:
        long = long.groupBy("metric", user).agg(F.avg("value").alias("value"))
    return long.groupBy("metric").agg(F.avg("value").alias("mean"))


def scored_rank(scored: DataFrame, gold: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """scored: user_id, item, score, place; gold: user_id, item. rank: 1 + items with a greater score + those with the same at an
    earlier place. Seen items count as lowest, and a seen gold item has no rank."""
    rows = scored
    if seen is not None:
        rows = rows.join(seen.select("user_id", "item").distinct().withColumn("_seen", F.lit(True)), ["user_id", "item"], "left").withColumn("score", F.when(F.col("_seen"), F.lit(float("-inf"))).otherwise(F.col("score")))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "place")))
    rank = F.when(F.col("score") > F.lit(float("-inf")), F.col("rank"))
    return gold.join(ranked.select("user_id", "item", rank.alias("rank")), ["user_id", "item"], "left")


#: Values that an Arrow batch draws for at a time; the matrix of counts has so many rows.
DRAWN = 2048


def poisson_counts(keys: np.ndarray, n_bootstrap: int) -> np.ndarray:
    """How often each value, by its 32-bit key, is in each resample: Poisson(1) draws that key and resample decide."""
    mask = np.uint64(0xFFFFFFFF)
    x = keys.astype(np.uint64)[:, None] ^ (np.arange(n_bootstrap, dtype=np.uint64) * np.uint64(0x9E3779B9) & mask)[None, :]
    x = (x ^ x >> np.uint64(16)) * np.uint64(0x85EBCA6B) & mask
    x = (x ^ x >> np.uint64(13)) * np.uint64(0xC2B2AE35) & mask
    u = ((x ^ x >> np.uint64(16)).astype(float) + 0.5) / 4294967296.0
    return np.searchsorted(POISSON, u, "left")


#: The chances of at most 0, 1, ... 7 copies.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])


def _picked_means(values: DataFrame, n_bootstrap: int, seed: int) -> DataFrame:
    """b, mean: means of bootstrap resamples of values (unit, value); null values are left out.

    Resampling n of n rows is drawn as a Poisson(1) number of copies of each row. A task multiplies its matrix of counts with its
    values, batch by batch, and emits one row of n_bootstrap sums, so no resample exists anywhere as rows, and what is
    shuffled does not depend on the number of values.
    """
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "unit")), 1, 8), 16, 10).cast("long")

    def run(batches):
        sums, sizes = np.zeros(n_bootstrap), np.zeros(n_bootstrap)
        for b in batches:
            keys, found = np.asarray(b.column("key")), np.asarray(b.column("value"))
            for i in range(0, len(keys), DRAWN):
                counts = poisson_counts(keys[i : i + DRAWN], n_bootstrap)
                sums += found[i : i + DRAWN] @ counts
                sizes += counts.sum(0)
        if sizes.any():
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.float64())) for x in (sums, sizes)], ["sums", "sizes"])

    rows = values.where("value is not null").select(key.alias("key"), F.col("value").cast("double").alias("value"))
    parts = rows.mapInArrow(run, "sums array<double>, sizes array<double>")
    each = parts.select(F.posexplode(F.arrays_zip("sums", "sizes")).alias("b", "x"))
    return each.groupBy("b").agg((F.sum("x.sums") / F.sum("x.sizes")).alias("mean")).where("mean is not null")


def metric_table(rows: DataFrame) -> DataFrame:
    """rows: user_id, metric, k, value, one for each judged row. metric, k, user_id, n, mean, n_users, user_mean.

    A row for each user, with the mean of the user's rows, and one for all (user_id null), with the mean over rows and that over
    users of their own means. Both levels come from one pass by grouping sets; it is written once, as users' means are averaged.
    """
    level = save(rows.groupingSets([["metric", "k", "user_id"], ["metric", "k"]], "metric", "k", "user_id").agg(F.grouping("user_id").alias("whole"), F.count("value").alias("n"), F.avg("value").alias("mean")), "levels")
    users = level.where("whole = 0").groupBy("metric", "k").agg(F.count("*").alias("n_users"), F.avg("mean").alias("user_mean"))
    return level.join(users.withColumn("whole", F.lit(1).cast(level.schema["whole"].dataType)), ["metric", "k", "whole"], "left").select("metric", "k", "user_id", "n", "mean", "n_users", "user_mean")


def bootstrap_ci(values: DataFrame, n_bootstrap: int = 1000, seed: int = 42, ci: float = 0.95) -> DataFrame:
    """values: unit, value. One row: mean, low, high (percentiles of the resampled means)."""
    point = values.agg(F.avg("value").alias("mean"))
    ends = _picked_means(values, n_bootstrap, seed).agg(F.sort_array(F.collect_list("mean")).alias("m"))
    low, high = int((1 - ci) / 2 * n_bootstrap), min(int((1 + ci) / 2 * n_bootstrap), n_bootstrap - 1)
    return point.join(ends.select(F.get("m", F.lit(low)).alias("low"), F.get("m", F.least(F.size("m") - 1, F.lit(high))).alias("high")))


def _differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """unit, d: the differences of two runs, which must have the same units, two at least, each once and with a value."""
    both = a.select("unit", F.col("value").alias("_a")).join(b.select("unit", F.col("value").alias("_b")), "unit", "full")
    d = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("paired runs must have the same units, with values"))).otherwise(F.col("_a") - F.col("_b"))
    return both.select("unit", d.cast("double").alias("d"))


def _enough(n: Column, out: Column) -> Column:
    return F.when(n < 2, F.raise_error(F.lit("a paired test takes two observations at least"))).otherwise(out)


def paired_bootstrap(a: DataFrame, b: DataFrame, n_bootstrap: int = 1000, seed: int = 42) -> DataFrame:
    """a, b: unit, value, the same units in both. One row: delta (mean of a - b), low, high, p_value: twice the share of resamples on
    the other side of 0."""
    d = _differences(a, b).withColumnRenamed("d", "value")
    point = d.agg(_enough(F.count("*"), F.avg("value")).alias("delta"))
    m = _picked_means(d, n_bootstrap, seed).join(F.broadcast(point))
    crossed = F.count_if(F.when(F.col("delta") > 0, F.col("mean") <= 0).when(F.col("delta") < 0, F.col("mean") >= 0).otherwise(F.lit(True)))
    out = m.agg(F.first("delta").alias("delta"), F.least(F.lit(1.0), 2 * crossed / F.count("*")).alias("p_value"), F.sort_array(F.collect_list("mean")).alias("m"))
    low, high = int(0.025 * n_bootstrap), min(int(0.975 * n_bootstrap), n_bootstrap - 1)
    return out.select("delta", F.get("m", F.lit(low)).alias("low"), F.get("m", F.least(F.size("m") - 1, F.lit(high))).alias("high"), "p_value")


def t_tail(t: Column, n: Column) -> Column:
    """Two-sided p-value of a t statistic with n - 1 degrees of freedom: the density in an angle, cos(x) ** (n - 2), integrated by
    Simpson's rule beyond the statistic's angle and over all of it."""
    steps, df = 2000, (n - 1).cast("double")
    full = F.least(F.lit(math.pi / 2), 40 / F.sqrt(df))  # beyond, nothing is left
    end = F.least(full, F.atan2(F.abs(t), F.sqrt(df)))

    def area(upto: Column) -> Column:
        h = upto / steps
        weight = lambda i: F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda s, i: s + weight(i) * F.pow(F.greatest(F.lit(0.0), F.cos(i * h)), df - 1)) * h / 3

    return F.greatest(F.lit(0.0), 1 - area(end) / area(full))


def paired_ttest(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: unit, value, the same units in both. One row: n, delta, sd, t, p_value, low, high: the paired t statistic, its two-sided
    p-value and delta -+ 1.96 standard errors. A constant difference other than 0 has an infinite t and a p-value of 0."""
    s = _differences(a, b).agg(F.count("*").alias("n"), _enough(F.count("*"), F.avg("d")).alias("delta"), F.stddev_samp("d").alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    t = F.when(se > 0, F.col("delta") / se).when(F.col("delta") == 0, 0.0).otherwise(F.signum("delta") * F.lit(float("inf")))
    s = s.withColumn("t", t).withColumn("p_value", F.when(F.abs("t") == float("inf"), 0.0).otherwise(t_tail(F.col("t"), F.col("n"))))
    return s.select("n", "delta", "sd", "t", "p_value", (F.col("delta") - 1.96 * se).alias("low"), (F.col("delta") + 1.96 * se).alias("high"))


def auroc(rows: DataFrame, key: str = "user_id") -> DataFrame:
    """key, auroc of score against label 0/1: the share of pairs in order, ties half; null where a class is missing. By ranks, not pairs."""
    w = Window.partitionBy(key)
    ties = F.count("*").over(Window.partitionBy(key, "score"))
    rank = F.rank().over(w.orderBy("score")) + (ties - 1) / 2
    g = rows.withColumn("_rank", rank).groupBy(key).agg(F.sum(F.when(F.col("label") == 1, F.col("_rank")).otherwise(0.0)).alias("s"), F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    return g.select(key, F.when((F.col("p") > 0) & (F.col("n") > 0), (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("n"))).alias("auroc"))


def spearman(rows: DataFrame, key: str, x: str, y: str, tie: str) -> DataFrame:
    """key, rho: correlation of the places by x and by y (ties by `tie`, not averaged); null under 3 rows."""
    w = Window.partitionBy(key)
    g = rows.withColumn("_x", F.row_number().over(w.orderBy(x, tie))).withColumn("_y", F.row_number().over(w.orderBy(y, tie)))
    return g.groupBy(key).agg(F.when(F.count("*") >= 3, F.corr(F.col("_x").cast("double"), F.col("_y").cast("double"))).alias("rho"))


def upper_median(rows: DataFrame, column: str) -> DataFrame:
    """One row, median: the middle value, of two the upper; null without values. Values are counted first, so no column is gathered:
    only the distinct values, with how many rows have each, are put in order, in ranges."""
    from .catalogue import running_sums

    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).count()
    half = counts.agg(F.sum("count").alias("n")).select(F.floor(F.col("n") / 2).alias("half"))
    upto = running_sums(counts.withColumn("_all", F.lit(0)), ["_all"], ["value"], "count", "upto")
    return upto.join(F.broadcast(half)).where("upto > half").agg(F.min("value").alias("median"))


def effective_ks(ks: tuple[int, ...], sampled_ks: tuple[int, ...] | None = None, n_negatives: int | None = None) -> tuple[int, ...]:
    """The places at which a pass is measured: with sampled negatives those of the sampled pass too."""
    return tuple(ks) if n_negatives is None or not sampled_ks else tuple(sorted({*ks, *sampled_ks}))


def oracle_cohorts(base: DataFrame, fused: DataFrame) -> DataFrame:
    """base, fused: user_id, rank of the gold item (null: not found). One row: what a perfect rerank of each pool could reach, where
    the gold items are, and whom the second run helped or hurt at 10."""
    j = base.select("user_id", F.col("rank").alias("r")).join(fused.select("user_id", F.col("rank").alias("f")), "user_id")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    r, hit, was = F.col("r"), F.coalesce(F.col("f") <= 10, F.lit(False)), F.coalesce(F.col("r") <= 10, F.lit(False))
    return j.agg(
        F.count("*").alias("n_users"), *(share(r <= k).alias(f"ceiling_{k}") for k in (20, 50, 100)), F.count_if(was).alias("already"), F.count_if(r.between(11, 20)).alias("r11_20"),
        F.count_if(r.between(21, 50)).alias("r21_50"), F.count_if(r.between(51, 100)).alias("r51_100"), F.count_if(r.isNull() | (r > 100)).alias("outside"), F.count_if(hit & ~was).alias("helped"), F.count_if(was & ~hit).alias("hurt"),
        (F.count_if(hit & ~was) - F.count_if(was & ~hit)).alias("net"),
    )


def cohort_deltas(base: DataFrame, fused: DataFrame, cohort: Column) -> DataFrame:
    """in_cohort, n_users, delta: mean difference of value (user_id, value) for users in a cohort and the others."""
    j = base.select("user_id", F.col("value").alias("b"), cohort.alias("in_cohort")).join(fused.select("user_id", F.col("value").alias("f")), "user_id")
    return j.groupBy("in_cohort").agg(F.count("*").alias("n_users"), F.avg(F.col("f") - F.col("b")).alias("delta"))


def no_regression(base: DataFrame, fused: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """metric, base, fused, ok of two tables of means."""
    j = base.select("metric", F.col("mean").alias("base")).join(fused.select("metric", F.col("mean").alias("fused")), "metric")
    return j.withColumn("ok", F.col("fused") + tolerance >= F.col("base"))


def pool_recall(train: DataFrame, cases: DataFrame, pool_size: int = 50) -> DataFrame:
    """One row: n_cases, recall of a popularity list of pool_size items without what the user has seen; cases (user_id, item)
    whose item was seen count as misses."""
    from .ranking import popular_unseen

    lists = popular_unseen(train, cases.select("user_id").distinct(), pool_size)
    found = cases.select("user_id", "item").join(lists.select("user_id", "item", F.lit(1.0).alias("_hit")), ["user_id", "item"], "left")
    return found.agg(F.count("*").alias("n_cases"), F.avg(F.coalesce("_hit", F.lit(0.0))).alias("recall"))
