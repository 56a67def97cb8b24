"""Quality of extracted triples against gold ones, summaries of an extraction, and agreement of annotators.

Triples are rows (review_id, aspect, sentiment, confidence); aspects are normalised here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import normalize_aspect, rating_bucket


def finalize(triples: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Confident triples, aspects normalised, the most confident one per (review, aspect, sentiment)."""
    rows = triples.withColumn("aspect", normalize_aspect(F.col("aspect"))).where(F.col("confidence") >= min_confidence)
    others = [c for c in rows.columns if c not in ("review_id", "aspect", "sentiment")]
    best = F.max_by(F.struct(*others), "confidence").alias("_b")
    return rows.groupBy("review_id", "aspect", "sentiment").agg(best).select("review_id", "aspect", "sentiment", "_b.*")


def matches(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """review_id, aspect, sentiment, p, g: the distinct keys of both, and who has them. Only reviews with a prediction set and a
    gold set count; a review with an empty set has one row with a null aspect."""
    key = lambda df, name: df.select("review_id", normalize_aspect(F.col("aspect")).alias("aspect"), "sentiment").distinct().withColumn(name, F.lit(True))
    both = predicted.select("review_id").distinct().join(gold.select("review_id").distinct(), "review_id")
    j = key(predicted, "p").join(key(gold, "g"), ["review_id", "aspect", "sentiment"], "full_outer").where("aspect is not null")
    return j.join(both, "review_id", "left_semi").na.fill(False, ["p", "g"])


def prf(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, tp, fp, fn, precision, recall, f1 (0 where undefined) of matches()."""
    n = rows.groupBy(*keys).agg(F.count_if(F.expr("p and g")).alias("tp"), F.count_if(F.expr("p and not g")).alias("fp"), F.count_if(F.expr("g and not p")).alias("fn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    n = n.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def micro(rows: DataFrame) -> DataFrame:
    return prf(rows)


def macro_review(rows: DataFrame) -> DataFrame:
    """One row: the mean f1 of reviews (both sets empty: left out), and the summed counts."""
    return prf(rows, "review_id").agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("f1"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))


def macro_aspect(rows: DataFrame, min_support: int = 5) -> DataFrame:
    """One row: the mean f1 of aspects with enough gold triples; null if none has."""
    return prf(rows, "aspect").where(F.col("tp") + F.col("fn") >= min_support).agg(F.avg("f1").alias("f1"), F.count("*").alias("n_aspects"))


def per_sentiment(rows: DataFrame, min_support: int = 10) -> DataFrame:
    """sentiment, its micro scores, the mean of its reviews' f1, gold support and whether that is low."""
    macro = prf(rows, "sentiment", "review_id").groupBy("sentiment").agg(F.avg("f1").alias("macro_f1"))
    out = prf(rows, "sentiment").join(macro, "sentiment").withColumn("support", F.col("tp") + F.col("fn"))
    return out.withColumn("low_support", F.col("support") < min_support)


def error_summary(rows: DataFrame) -> DataFrame:
    """One row of counts of reviews: perfect, missed (gold aspects not found), spurious, sentiment_flip (aspect found, other sentiment)."""
    aspects = rows.groupBy("review_id", "aspect").agg(F.max("p").alias("p"), F.max("g").alias("g"), F.max(F.expr("p and g")).alias("same"))
    r = aspects.groupBy("review_id").agg(F.max(F.expr("g and not p")).alias("missed"), F.max(F.expr("p and not g")).alias("spurious"), F.max(F.expr("p and g and not same")).alias("flip"))
    exact = rows.groupBy("review_id").agg(F.min(F.expr("p and g")).alias("perfect"))
    r = r.join(exact, "review_id")
    return r.agg(F.count_if(F.expr("perfect")).alias("perfect"), F.count_if(F.expr("missed")).alias("missed"), F.count_if(F.expr("spurious")).alias("spurious"), F.count_if(F.expr("flip")).alias("sentiment_flip"))


def summary(reviews: DataFrame, triples: DataFrame) -> DataFrame:
    """One row: n_reviews, with_triples, empty, n_triples, mean per review."""
    n = reviews.select("review_id").distinct().join(triples.groupBy("review_id").agg(F.count("*").alias("n")), "review_id", "left").na.fill(0, ["n"])
    return n.agg(F.count("*").alias("n_reviews"), F.count_if(F.expr("n > 0")).alias("with_triples"), F.count_if(F.expr("n = 0")).alias("empty"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_triples"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean_triples"))


def aspect_counts(triples: DataFrame, min_support: int = 1) -> DataFrame:
    n = triples.groupBy(normalize_aspect(F.col("aspect")).alias("aspect")).agg(F.count("*").alias("n"))
    return n.where(F.col("n") >= min_support)


def sentiment_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("sentiment").agg(F.count("*").alias("n"))


def aspect_vocabulary(triples: DataFrame, k: int = 100, min_support: int = 5, other: str = "OTHER") -> DataFrame:
    """id, aspect, n: the k most frequent aspects (ties by name) numbered from 1, and id 0 for all others."""
    counts = aspect_counts(triples, min_support).orderBy(F.desc("n"), "aspect").limit(k)
    numbered = counts.select(F.row_number().over(Window.orderBy(F.desc("n"), "aspect")).alias("id"), "aspect", "n")
    rest = counts.sparkSession.createDataFrame([(0, other, 0)], "id int, aspect string, n long")
    return rest.unionByName(numbered)


def with_aspect_id(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Adds aspect_id; aspects outside the vocabulary (at most k + 1 rows) get 0."""
    ids = vocabulary.where("id > 0").select(F.col("aspect").alias("_a"), F.col("id").alias("aspect_id"))
    return rows.join(F.broadcast(ids), normalize_aspect(F.col("aspect")) == F.col("_a"), "left").drop("_a").na.fill(0, ["aspect_id"])


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n, the mean Jaccard of two annotators' sets over the reviews that both did; two empty sets agree."""
    sets = lambda df, name: df.groupBy("review_id").agg(F.collect_set(F.when(F.col("aspect").isNotNull(), F.concat_ws("|", normalize_aspect(F.col("aspect")), "sentiment"))).alias(name))
    j = sets(a, "x").join(sets(b, "y"), "review_id")
    share = F.coalesce(F.size(F.array_intersect("x", "y")) / F.nullif(F.size(F.array_union("x", "y")), F.lit(0)), F.lit(1.0))
    return j.agg(F.count("*").alias("n"), F.avg(share).alias("jaccard"))


def stratified_sample(reviews: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n reviews (review_id, rating, text), about evenly from the strata of rating bucket and quarter of length, filled up from all."""
    words = F.size(F.split(F.trim("text"), r"\s+"))
    rows = reviews.withColumn("_words", words)
    cuts = rows.agg(F.expr("percentile_approx(_words, array(0.25, 0.5, 0.75), 10000)").alias("_q"))
    quarter: Column = sum(((F.col("_words") > F.col("_q")[i]).cast("int") for i in range(3)), F.lit(0))
    rows = rows.join(F.broadcast(cuts)).withColumn("stratum", F.concat_ws("/", rating_bucket(F.col("rating")), quarter.cast("string")))
    draw = F.xxhash64(F.lit(seed), "review_id")
    nth = F.row_number().over(Window.partitionBy("stratum").orderBy(draw, "review_id"))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= n).orderBy("_nth", draw, "review_id").limit(n).drop("_words", "_q", "_nth")
