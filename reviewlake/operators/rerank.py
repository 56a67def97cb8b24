"""Around a second-stage reranker: who is eligible, what it may promote, what it missed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dot, minmax
from .ranking import top_k, vector_topk


def eligible(cases: DataFrame, texts: DataFrame, override: bool = False) -> DataFrame:
    """cases: user_id, query_ts. Those with a preference text that is not blank and rests on reviews; with override all."""
    if override:
        return cases
    good = texts.where("trim(coalesce(text, '')) <> '' and has_reviews").select("user_id", F.col("ts").alias("query_ts")).distinct()
    return cases.join(good, ["user_id", "query_ts"], "left_semi")


def scorecard_picks(cards: DataFrame, k: int, margin: int = 2) -> DataFrame:
    """cards: user_id, item, place, fit, displacee_fit, beats_displacee, evidence. The first k that beat whom they displace by
    `margin` and say why; an item counts at its first place."""
    ok = cards.where(F.col("beats_displacee") & (F.trim(F.coalesce("evidence", F.lit(""))) != "") & (F.col("fit") >= F.col("displacee_fit") + margin))
    first = ok.groupBy("user_id", "item").agg(F.min("place").alias("place"))
    return top_k(first, k, ["user_id"], ["place", "item"]).select("user_id", "item", "rank")


def focus(pool: DataFrame, cap: int, low: int = 11, high: int = 20) -> DataFrame:
    """pool: user_id, item, rank, hits and perhaps phi. With phi the best `cap` by it; else the near misses (places low to high),
    filled up with the items that share most with the text."""
    if "phi" in pool.columns:
        order: list[Column] = [F.desc("phi"), F.col("old")]
    else:
        near = F.col("old").between(low, high)
        order = [F.desc(near.cast("int")), F.when(near, F.col("old")), F.desc("hits"), F.col("old")]
    return top_k(pool.withColumnRenamed("rank", "old"), cap, ["user_id"], order).drop("old")


def repaired(order: DataFrame, pool: DataFrame, allowed: DataFrame) -> DataFrame:
    """The allowed items (user_id, item) in the order of a list (user_id, item, rank), then the other allowed ones of the pool
    (user_id, item, total) from the best down."""
    first = order.groupBy("user_id", "item").agg(F.min("rank").alias("_r"))
    rows = pool.join(allowed.select("user_id", "item"), ["user_id", "item"], "left_semi").join(first, ["user_id", "item"], "left")
    return top_k(rows, None, ["user_id"], [F.col("_r").asc_nulls_last(), F.desc("total"), "item"]).select("user_id", "item", "rank")


def funnel_audit(gold: DataFrame, stage1: DataFrame, shortlist: DataFrame, picks: DataFrame, final: DataFrame, near: tuple[int, int] = (11, 100), k: int = 10) -> DataFrame:
    """One row: of the gold items (user_id, item) that the first stage has at places `near`, how many the shortlist misses, how
    many it has but are not picked, how many are picked but end beyond k, and how many are rescued."""
    mark = lambda df, name: df.select("user_id", "item", F.lit(True).alias(name)).distinct()
    rows = gold.join(stage1.where(F.col("rank").between(*near)).select("user_id", "item"), ["user_id", "item"])
    rows = rows.join(mark(shortlist, "s"), ["user_id", "item"], "left").join(mark(picks, "p"), ["user_id", "item"], "left").join(mark(final.where(F.col("rank") <= k), "f"), ["user_id", "item"], "left").na.fill(False, ["s", "p", "f"])
    return rows.agg(
        F.count("*").alias("near_misses"), F.count_if(F.expr("not s")).alias("shortlist_miss"), F.count_if(F.expr("s and not p")).alias("pick_miss"), F.count_if(F.expr("p and not f")).alias("placement_miss"), F.count_if("f").alias("rescued"),
    )


def aspect_maps(sentiment: DataFrame) -> DataFrame:
    """item, scores, e_hats, support: an item's aspects as maps, for lookups by item."""
    made = {"scores": "score", "e_hats": "e_hat", "support": "n_support"}
    return sentiment.groupBy("item").agg(*(F.map_from_entries(F.sort_array(F.collect_list(F.struct("aspect", c)))).alias(n) for n, c in made.items()))


def adjusted_scores(candidates: DataFrame, users: DataFrame, items: DataFrame, aspects: DataFrame, gammas: DataFrame) -> DataFrame:
    """candidates: user_id, item; the others: key, vector; gammas: user_id, aspect, gamma. Adds score: the dot product of the item
    with the user's vector moved by gamma along each aspect's, scaled to 0..1 within the user's candidates; 0 for unknown users."""
    rows = candidates.join(moved_vectors(users, aspects, gammas).withColumnRenamed("vector", "_u"), "user_id", "left").join(items.select(F.col("key").alias("item"), F.col("vector").alias("_i")), "item", "left")
    raw = rows.withColumn("_s", F.coalesce(dot(F.col("_u"), F.col("_i")), F.lit(0.0)))
    return raw.select(*candidates.columns, minmax(F.col("_s"), Window.partitionBy("user_id")).alias("score"))


def moved_vectors(users: DataFrame, aspects: DataFrame, gammas: DataFrame) -> DataFrame:
    """user_id, vector: each known user's vector moved by gamma along each aspect's."""
    moved = gammas.join(aspects.select(F.col("key").alias("aspect"), F.posexplode("vector").alias("dim", "x")), "aspect").groupBy("user_id", "dim").agg(F.sum(F.col("gamma") * F.col("x")).alias("x"))
    own = users.select(F.col("key").alias("user_id"), F.posexplode("vector").alias("dim", "x")).unionByName(moved.select("user_id", "dim", "x"))
    known = own.groupBy("user_id", "dim").agg(F.sum("x").alias("x")).join(users.select(F.col("key").alias("user_id")), "user_id", "left_semi")
    return known.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vector"))


def adjusted_best(asked: DataFrame, catalogue: DataFrame, users: DataFrame, items: DataFrame, aspects: DataFrame, gammas: DataFrame, k: int | None) -> DataFrame:
    """user_id, item, score, rank: the k best (None: all) of the whole catalogue (item) for each asked user_id, by scores as of adjusted_scores().

    Vectors meet in blocks; the least raw score, which the scale needs, is the greatest one of the vectors turned round.
    """
    query = asked.select("user_id").distinct().join(moved_vectors(users, aspects, gammas), "user_id", "left").withColumnRenamed("vector", "query")
    vectors = catalogue.select("item").distinct().join(items.select(F.col("key").alias("item"), "vector"), "item", "left")
    top = vector_topk(query, vectors, k, "dot")
    least = vector_topk(query.withColumn("query", F.transform("query", lambda x: -x)), vectors, 1, "dot").select("user_id", (-F.col("score")).alias("_low"))
    most = top.where("rank = 1").select("user_id", F.col("score").alias("_high"))
    wide = top.join(least, "user_id").join(most, "user_id")
    span = F.col("_high") - F.col("_low")
    return wide.select("user_id", "item", F.when(span < 1e-12, 0.0).otherwise((F.col("score") - F.col("_low")) / span).alias("score"), "rank")


def token_budget(sizes: Column, cap: int = 4096, per_id: int = 18) -> Column:
    """Answer tokens that a ranking of so many ids (an array of pool sizes) needs, capped."""
    return F.least(F.lit(cap), F.aggregate(sizes, F.lit(0), lambda s, x: s + x * per_id + 32))
