"""Explanations of recommendations that name only what moved the score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_opinion(signals: DataFrame) -> DataFrame:
    """user_id, aspect, direction: what the user last said of an aspect (positive, negative, neutral); of equal times the first row."""
    last = F.max_by("polarity", F.struct("ts", -F.col("row_id")))
    said = signals.groupBy("user_id", "aspect").agg(last.alias("_p"))
    return said.select("user_id", "aspect", F.when(F.col("_p") > 0, "positive").when(F.col("_p") < 0, "negative").otherwise("neutral").alias("direction"))


def explanations(parts: DataFrame, weights: DataFrame, sentiment: DataFrame, signals: DataFrame, drivers: int = 3, specs: DataFrame | None = None) -> DataFrame:
    """parts: user_id, item, aspect, part (what an aspect adds to the score); specs: item, key, value, facts that may be cited.

    user_id, item, evidence (array of aspect, contribution, e_hat, n_support, user_weight: the `drivers` greatest parts, ties by
    aspect), claims (a sentence per driver, then "key: value" of each fact that is not null, by key) and summary. Only aspects of
    parts are cited, so no claim can name what did not count; an unknown e_hat, support or weight is 0.
    """
    nth = F.row_number().over(Window.partitionBy("user_id", "item").orderBy(F.desc("part"), "aspect"))
    top = parts.select("user_id", "item", "aspect", "part").withColumn("nth", nth).where(F.col("nth") <= drivers)
    rows = top.join(sentiment.select("item", "aspect", "e_hat", "n_support"), ["item", "aspect"], "left").join(weights.select("user_id", "aspect", "weight"), ["user_id", "aspect"], "left")
    rows = rows.join(latest_opinion(signals), ["user_id", "aspect"], "left").na.fill(0, ["e_hat", "n_support", "weight"])
    # The sentences of claims and of the summary below, which readers of explanations expect word for word.
    fact = F.format_string("This item rates %s on %s (Ê=%.2f, %d supporting reviews, contribution %.3f)", F.when(F.col("e_hat") >= 0.5, "positively").otherwise("negatively"), "aspect", "e_hat", "n_support", "part")
    said = F.concat(F.lit("you previously expressed "), "direction", F.lit(" sentiment about "), "aspect", F.lit("; "))
    claim = F.concat(F.coalesce(said, F.lit("")), fact)
    one = F.struct("nth", "aspect", F.col("part").alias("contribution"), "e_hat", "n_support", F.col("weight").alias("user_weight"), claim.alias("claim"))
    listed = rows.groupBy("user_id", "item").agg(F.sort_array(F.collect_list(one)).alias("_e"))
    aspects = F.array_join(F.col("_e.aspect"), ", ")
    summary = F.format_string("Recommended %s because it aligns with your priorities on %s (top driver contribution: %.3f).", "item", aspects, F.col("_e")[0]["contribution"])
    claims = F.col("_e.claim")
    if specs is not None:
        known = specs.where("value is not null").groupBy("item").agg(F.transform(F.sort_array(F.collect_list(F.struct("key", "value"))), lambda s: F.concat(s["key"], F.lit(": "), s["value"].cast("string"))).alias("_specs"))
        listed = listed.join(known, "item", "left")
        claims = F.concat(claims, F.coalesce("_specs", F.array().cast("array<string>")))
    evidence = F.transform("_e", lambda e: F.struct(e["aspect"].alias("aspect"), e["contribution"].alias("contribution"), e["e_hat"].alias("e_hat"), e["n_support"].alias("n_support"), e["user_weight"].alias("user_weight")))
    return listed.select("user_id", "item", evidence.alias("evidence"), claims.alias("claims"), summary.alias("summary"))
