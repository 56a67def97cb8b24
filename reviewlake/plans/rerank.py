"""The second stage as one plan: boosts, lexical evidence, promotion into the head, guardrail. A list that fails stays as it was."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import mix_vectors
from ..functions.session import save
from ..operators import features, ranking, text


def second_stage(stage1: DataFrame, boosts: DataFrame, texts: DataFrame, meta: DataFrame, pool_k: int = 50, promote_k: int = 1, protect_n: int = 9, scale: float = 0.05, top_n: int = 5, max_drop: int = 10) -> DataFrame:
    """stage1: user_id, item, rank, score; boosts: user_id, item, score; texts: user_id, text; meta: item, name, categories.

    user_id, item, rank: the first stage's lists, their pools reordered by boosts, then `promote_k` items with more of the user's
    words than those they displace swapped into the head's end. Users whose text is blank, or whose list would move one of
    its first top_n items beyond max_drop, keep their list.
    """
    pool = features.boosted(stage1.where(F.col("rank") <= pool_k), boosts, scale)
    words = save(texts.where("trim(coalesce(text, '')) <> ''").select("user_id", text.preference_tokens(F.col("text")).alias("query_tokens")), "words")
    known = text.with_item_tokens(meta).select("item", "item_tokens")
    empty = F.array().cast("array<string>")
    rows = pool.join(words, "user_id").join(known, "item", "left").withColumn("item_tokens", F.coalesce("item_tokens", empty))
    scored = save(features.lexical_scores(rows).select("user_id", "item", "rank", "score", "hits"), "scored")
    picks = features.lexical_picks(scored, promote_k, protect_n + promote_k)
    merged = save(ranking.merge_ranking(ranking.promote_swap(scored, picks, promote_k, protect_n), stage1.join(words.select("user_id"), "user_id", "left_semi"), pool_k), "merged")
    good = ranking.guardrail(stage1, merged, top_n, max_drop).where("ok").select("user_id")
    plain = stage1.join(good, "user_id", "left_anti").select("user_id", "item", F.col("rank").cast("int").alias("rank"))
    return merged.join(good, "user_id", "left_semi").unionByName(plain)


def context_stage(stage1: DataFrame, boosts: DataFrame, phi: DataFrame, texts: DataFrame, meta: DataFrame, weights: dict[str, float], rerank=None, pool_k: int = 50, cap: int = 20, scale: float = 0.05, top_n: int = 5, max_drop: int = 10) -> DataFrame:
    """The window mode. stage1: user_id, item, rank, score; boosts: user_id, item, score; phi: user_id, item, phi; texts, meta as above.

    user_id, item, rank: pools reordered by boosts; a window of `cap` items by the weighted z-scores of phi, text and co; the window in
    a model's order (rerank: window rows to user_id, item, rank; None keeps its own) in front, the rest of the pool and of the
    first stage after it. Users without a text, or whose list fails the guardrail, keep the first stage's list.
    """
    pool = features.boosted(stage1.where(F.col("rank") <= pool_k), boosts, scale)
    words = save(texts.where("trim(coalesce(text, '')) <> ''").select("user_id", text.preference_tokens(F.col("text")).alias("query_tokens")), "words")
    known = text.with_item_tokens(meta).select("item", "item_tokens")
    rows = pool.join(words, "user_id").join(known, "item", "left").withColumn("item_tokens", F.coalesce("item_tokens", F.array().cast("array<string>")))
    rows = features.lexical_scores(rows).join(phi.select("user_id", "item", "phi"), ["user_id", "item"], "left").join(boosts.select("user_id", "item", F.col("score").alias("co")), ["user_id", "item"], "left")
    rows = save(rows.select("user_id", "item", "rank", "hits", F.col("text_score").alias("text"), F.coalesce("phi", F.lit(0.0)).alias("phi"), F.coalesce("co", F.lit(0.0)).alias("co")), "rows")
    window = features.weighted_window(rows, weights, cap).select("user_id", "item", "rank")
    front = window if rerank is None else rerank(window)
    own = stage1.join(words.select("user_id"), "user_id", "left_semi")
    merged = save(ranking.merge_ranking(ranking.reorder_head(rows.select("user_id", "item", "rank"), front, 2**30), own, pool_k), "merged")
    return guarded(stage1, merged, top_n, max_drop)


def guarded(stage1: DataFrame, merged: DataFrame, top_n: int = 5, max_drop: int = 10) -> DataFrame:
    """The merged lists of users whose first top_n items stay within max_drop, and the first stage's lists of all others."""
    good = ranking.guardrail(stage1, merged, top_n, max_drop).where("ok").join(merged.select("user_id").distinct(), "user_id", "left_semi").select("user_id")
    plain = stage1.join(good, "user_id", "left_anti").select("user_id", "item", F.col("rank").cast("int").alias("rank"))
    return merged.join(good, "user_id", "left_semi").select("user_id", "item", "rank").unionByName(plain)


def aligned_full_rank(users: DataFrame, preferences: DataFrame, items: DataFrame, k: int, alpha: float = 0.7) -> DataFrame:
    """users: user_id, vector (of their sequence); preferences: user_id, vector (of their text); items: item, vector. The k items of the
    whole catalogue with the greatest dot product with alpha * sequence + (1 - alpha) * preference; users without a text
    go by their sequence alone."""
    own = users.select("user_id", F.col("vector").alias("_s")).join(preferences.select("user_id", F.col("vector").alias("_p")), "user_id", "left")
    queries = own.select("user_id", mix_vectors(F.col("_s"), F.col("_p"), alpha).alias("query"))
    return ranking.vector_topk(queries, items, k, "dot")


def select_pool(pool: DataFrame, scores: DataFrame, size: int) -> DataFrame:
    """pool: user_id, item. All of a user's items where they are `size` at most, else the `size` best by scores (user_id, item,
    score; 0 where missing), ties by item."""
    scored = pool.select("user_id", "item").distinct().join(scores.select("user_id", "item", "score"), ["user_id", "item"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return ranking.rank_by_score(scored, size).select("user_id", "item", "rank")
