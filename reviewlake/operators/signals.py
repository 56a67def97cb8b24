"""Aspect sentiment: signals (user_id, item, aspect, polarity, helpful, ts), weights that decay with time, item sentiment, S(u, i)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DAY_US, clamp


def known_before(signals: DataFrame, queries: DataFrame) -> DataFrame:
    """signals with query_ts: those strictly before each (user_id, query_ts), so that nothing leaks."""
    return signals.join(queries.select("user_id", "query_ts"), "user_id").where(F.col("ts") < F.col("query_ts"))


def decay(rate: float) -> Column:
    return F.exp(-F.lit(rate) * (F.col("query_ts") - F.col("ts")) / F.lit(float(DAY_US)))


def interest_scores(signals: DataFrame, queries: DataFrame, rate: float = 0.01) -> DataFrame:
    """user_id, query_ts, aspect, interest (strength decayed by age) and gamma (the same, signed and squared in strength)."""
    p = F.col("polarity")
    return known_before(signals, queries).groupBy("user_id", "query_ts", "aspect").agg(F.sum(F.abs(p) * decay(rate)).alias("interest"), F.sum(p * F.abs(p) * decay(rate)).alias("gamma"))


def decayed_weights(signals: DataFrame, queries: DataFrame, rate: float = 0.01) -> DataFrame:
    """user_id, query_ts, aspect, weight: interests that sum to 1 for each query; users with neutral signals only have none."""
    total = F.sum("interest").over(Window.partitionBy("user_id", "query_ts"))
    return interest_scores(signals, queries, rate).withColumn("_total", total).where("_total > 0").select("user_id", "query_ts", "aspect", (F.col("interest") / F.col("_total")).alias("weight"))


def static_weights(signals: DataFrame) -> DataFrame:
    """user_id, aspect, weight without decay and without a query time."""
    rows = signals.groupBy("user_id", "aspect").agg(F.sum(F.abs("polarity")).alias("interest"))
    total = F.sum("interest").over(Window.partitionBy("user_id"))
    return rows.withColumn("_total", total).where("_total > 0").select("user_id", "aspect", (F.col("interest") / F.col("_total")).alias("weight"))


def top_aspects(weights: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("user_id", "query_ts").orderBy(F.desc("weight"), "aspect")
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def item_sentiment(signals: DataFrame, helpful_cap: int = 10) -> DataFrame:
    """item, aspect, score (mean polarity, weighted by 1 + helpful votes up to the cap), e_hat (on 0 to 1), n_support, plain (the unweighted mean)."""
    w = 1 + F.least(F.greatest(F.col("helpful"), F.lit(0)), F.lit(helpful_cap))
    out = signals.groupBy("item", "aspect").agg((F.sum(w * F.col("polarity")) / F.sum(w)).alias("score"), F.count("*").alias("n_support"), F.avg("polarity").alias("plain"))
    return out.withColumn("e_hat", clamp((F.col("score") + 1) / 2, 0.0, 1.0))


def strong_items(sentiment: DataFrame, wanted: DataFrame, k: int, tau: float = 0.65, min_support: int = 3) -> DataFrame:
    """wanted: user_id, aspect, weight. The k items best on a user's wanted aspects, by weighted e_hat, then item."""
    good = sentiment.where((F.col("n_support") >= min_support) & (F.col("e_hat") >= tau))
    scored = wanted.join(good, "aspect").groupBy("user_id", "item").agg(F.sum(F.col("weight") * F.col("e_hat")).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), "item"))).where(F.col("rank") <= k)


def recent_complaints(signals: DataFrame, queries: DataFrame, polarity: float = -0.3, days: int = 30) -> DataFrame:
    """user_id, aspect, first_ts: aspects with a complaint in the days before the query, the earliest first."""
    near = known_before(signals, queries).where((F.col("polarity") < polarity) & (F.col("query_ts") - F.col("ts") <= days * DAY_US))
    return near.groupBy("user_id", "aspect").agg(F.min("ts").alias("first_ts"))


def shift_users(signals: DataFrame, complaint: float = 0.5, salience: float = 0.1) -> DataFrame:
    """user_id, aspect: users whose last signal is a strong complaint about an aspect that mattered little to them before."""
    last = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("row_id"))
    rows = signals.withColumn("_back", F.row_number().over(last)).withColumn("_n", F.count("*").over(Window.partitionBy("user_id"))).where("_n >= 2")
    latest = rows.where(F.col("_back") == 1).where(F.col("polarity") <= -complaint).select("user_id", "aspect")
    before = static_weights(rows.where(F.col("_back") > 1))
    return latest.join(before, ["user_id", "aspect"], "left").where(F.coalesce("weight", F.lit(0.0)) <= salience).select("user_id", "aspect")


def affinity_scores(candidates: DataFrame, weights: DataFrame, sentiment: DataFrame) -> DataFrame:
    """candidates: user_id, item. Adds score, the sum over aspects of weight * e_hat; aspects that an item lacks add 0.

    The sentiments of all candidate items are summed in one aggregation after two equi-joins; no list of aspects is built.
    """
    terms = candidates.select("user_id", "item").join(weights.select("user_id", "aspect", "weight"), "user_id").join(sentiment.select("item", "aspect", "e_hat"), ["item", "aspect"])
    summed = terms.groupBy("user_id", "item").agg(F.sum(F.col("weight") * F.col("e_hat")).alias("score"))
    return candidates.join(summed, ["user_id", "item"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def s_ui(base: DataFrame, weights: DataFrame, sentiment: DataFrame, alpha: float = 0.5) -> DataFrame:
    """base: user_id, item, s_base. Adds base_part = alpha * s_base, affective = (1 - alpha) * sum of weight * e_hat, total."""
    scored = affinity_scores(base, weights, sentiment)
    return scored.select(*base.columns, (alpha * F.col("s_base")).alias("base_part"), ((1 - alpha) * F.col("score")).alias("affective"), (alpha * F.col("s_base") + (1 - alpha) * F.col("score")).alias("total"))


def contributions(base: DataFrame, weights: DataFrame, sentiment: DataFrame, alpha: float = 0.5) -> DataFrame:
    """user_id, item, aspect, part: what each aspect adds to S(u, i)."""
    terms = base.select("user_id", "item").join(weights.select("user_id", "aspect", "weight"), "user_id").join(sentiment.select("item", "aspect", "e_hat"), ["item", "aspect"])
    return terms.select("user_id", "item", "aspect", ((1 - alpha) * F.col("weight") * F.col("e_hat")).alias("part"))


def faithfulness(scored: DataFrame, parts: DataFrame, targets: DataFrame, cited: DataFrame) -> DataFrame:
    """What the cited aspects are worth: scored (user_id, item, base_part, total), parts, targets (user_id, item), cited (user_id, aspect).

    user_id, item, rank_before, rank_after (without the cited parts of the target only), rank_drop, comprehensiveness (score
    lost), sufficiency_gap (score that the base and the cited parts leave unexplained), faithful.
    """
    worth = targets.join(parts, ["user_id", "item"]).join(cited, ["user_id", "aspect"], "left_semi").groupBy("user_id", "item").agg(F.sum("part").alias("worth"))
    own = targets.join(scored, ["user_id", "item"]).join(worth, ["user_id", "item"], "left").select("user_id", F.col("item").alias("target"), "total", "base_part", F.coalesce("worth", F.lit(0.0)).alias("worth"))
    own = own.withColumn("after", F.col("total") - F.col("worth"))
    rivals = scored.select("user_id", "item", F.col("total").alias("rival")).join(own, "user_id").where("item <> target")
    ahead = lambda mine: F.count_if((F.col("rival") > F.col(mine)) | ((F.col("rival") == F.col(mine)) & (F.col("item") < F.col("target"))))
    ranks = rivals.groupBy("user_id", "target").agg((1 + ahead("total")).alias("rank_before"), (1 + ahead("after")).alias("rank_after"))
    out = own.join(ranks, ["user_id", "target"], "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("rank_before", "rank_after")})
    return out.select(
        "user_id", F.col("target").alias("item"), "rank_before", "rank_after", (F.col("rank_after") - F.col("rank_before")).alias("rank_drop"), F.col("worth").alias("comprehensiveness"),
        F.abs(F.col("total") - F.col("base_part") - F.col("worth")).alias("sufficiency_gap"), (F.col("rank_after") > F.col("rank_before")).alias("faithful"),
    )


def counterfactual_probe(signals: DataFrame, queries: DataFrame, base: DataFrame, sentiment: DataFrame, inject: DataFrame, rate: float = 0.01, alpha: float = 0.5, polarity: float = -0.9) -> DataFrame:
    """inject: user_id, aspect. A complaint about the aspect just before the query; the rank of the candidate best on it, before and after.

    Scores that agree to nine digits are equal: the order in which terms were added must not rank them."""
    best = base.select("user_id", "item").join(inject, "user_id").join(sentiment.select("item", "aspect", "e_hat"), ["item", "aspect"], "left")
    target = best.groupBy("user_id").agg(F.max_by("item", F.struct(F.coalesce("e_hat", F.lit(0.0)), "item")).alias("target"))
    made = inject.join(queries, "user_id").select("user_id", "aspect", F.lit(polarity).alias("polarity"), (F.col("query_ts") - 1).alias("ts"))

    def ranks(of: DataFrame, name: str) -> DataFrame:
        scored = s_ui(base, decayed_weights(of, queries, rate), sentiment, alpha)
        ranked = scored.withColumn(name, F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc(F.round("total", 9)), "item")))
        return ranked.join(target, "user_id").where("item = target").select("user_id", "item", name)

    plain = signals.select("user_id", "aspect", "polarity", "ts")
    out = ranks(plain, "rank_before").join(ranks(plain.unionByName(made), "rank_after"), ["user_id", "item"])
    return out.withColumn("moved_up", F.col("rank_after") < F.col("rank_before"))


def passes_constraints(pool: DataFrame, sentiment: DataFrame, excluded: DataFrame, min_aspects: dict[str, float], max_price: float | None = None) -> DataFrame:
    """pool: user_id, item, price. Rows that are not excluded (user_id, item), cost at most max_price (an unknown price passes)
    and reach every minimum, an aspect that the item lacks counting as 0."""
    out = pool.join(excluded, ["user_id", "item"], "left_anti")
    if max_price is not None:
        out = out.where(F.coalesce(F.col("price") <= max_price, F.lit(True)))
    wanted = {a: m for a, m in min_aspects.items() if m > 0}
    if wanted:
        ok = F.count_if(F.coalesce(*[F.when(F.col("aspect") == a, F.col("e_hat") >= m) for a, m in wanted.items()], F.lit(False)))
        good = sentiment.where(F.col("aspect").isin(*wanted)).groupBy("item").agg(ok.alias("_ok")).where(F.col("_ok") == len(wanted)).select("item")
        out = out.join(good, "item", "left_semi")
    return out


def reflection(recommended: DataFrame, complaints: DataFrame, sentiment: DataFrame, budget: float, min_e_hat: float = 0.4, high: float = 0.75) -> DataFrame:
    """recommended: user_id, item, price, price_percentile. Rows user_id, item, violation: over the budget; a price that is unknown
    where the item's kind is dear; weak on an aspect that the user complained about (e_hat unknown: 0.5)."""
    price = F.when(F.col("price") > budget, "budget").when(F.col("price").isNull() & (F.col("price_percentile") > high), "price_unknown")
    money = recommended.select("user_id", "item", price.alias("violation")).where("violation is not null")
    met = recommended.select("user_id", "item").join(complaints.select("user_id", "aspect"), "user_id").join(sentiment.select("item", "aspect", "e_hat"), ["item", "aspect"], "left")
    weak = met.where(F.coalesce("e_hat", F.lit(0.5)) < min_e_hat).select("user_id", "item", F.concat(F.lit("complaint_aspect:"), "aspect").alias("violation"))
    return money.unionByName(weak)


def constraints_of(violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """violations: user_id, item, violation, as reflection() gives them. (excluded, minima): the items over a user's budget, user_id
    and item; and what the user complained about, user_id, aspect and the least score of 0.5 that items must reach there."""
    excluded = violations.where("violation = 'budget'").select("user_id", "item").distinct()
    aspect = F.regexp_extract("violation", "^complaint_aspect:(.*)$", 1)
    minima = violations.where("violation like 'complaint_aspect:%'").select("user_id", aspect.alias("aspect")).distinct().withColumn("least", F.lit(0.5))
    return excluded, minima


def reach_minima(pool: DataFrame, sentiment: DataFrame, minima: DataFrame) -> DataFrame:
    """Rows of pool (user_id, item) that reach all minima (user_id, aspect, least) of their user; an aspect that the item lacks
    counts as 0."""
    asked = pool.select("user_id", "item").join(minima, "user_id").join(sentiment.select("item", "aspect", "e_hat"), ["item", "aspect"], "left")
    return pool.join(asked.where(F.coalesce("e_hat", F.lit(0.0)) < F.col("least")).select("user_id", "item").distinct(), ["user_id", "item"], "left_anti")
