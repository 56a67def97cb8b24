"""Item potential: channels per (user_id, item) of a pool, their z-scores, and a listwise model over them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by, category_tokens, clamp, jaccard, name_tokens, sigmoid, zscore
from .listwise import fit_folds, fold_of
from .ranking import top_k

# How the channels are weighted, for the plain mix and for the residual on top of the sequence score.
PHI_WEIGHTS = {"text": 0.45, "co": 0.25, "hist": 0.20, "seq": 0.10}
RESIDUAL_WEIGHTS = {"text": 0.25, "co": 0.15, "hist": 0.15, "last_co": 0.25, "cat": 0.20}
CHANNELS = ("seq", "text", "co", "hist", "last_co", "cat", "pop", "markov", "brand")


def pool_window():
    return by("user_id")


def with_zscores(pool: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Adds z_<channel> within each user's pool; a channel that does not vary, or is missing, is 0."""
    have = {c: F.coalesce(F.col(c), F.lit(0.0)) if c in pool.columns else F.lit(0.0) for c in channels}
    return pool.withColumns({f"z_{c}": zscore(x, pool_window()) for c, x in have.items()})


def mix_channels(z: DataFrame, weights: dict[str, float] = PHI_WEIGHTS) -> DataFrame:
    """Adds phi: the weighted z-scores, weights renormalised over the channels that vary in the user's pool."""
    live = {c: F.max(F.abs(f"z_{c}")).over(pool_window()) > 0 for c in weights}
    total = sum((F.when(live[c], w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    mixed = sum((F.when(live[c], F.lit(w) * F.col(f"z_{c}")).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return z.withColumn("phi", F.when(total > 0, mixed / total).otherwise(0.0))


def mix_residual(z: DataFrame, alpha: float = 0.15, weights: dict[str, float] = RESIDUAL_WEIGHTS) -> DataFrame:
    """Adds phi: the sequence z-score and alpha times the residual mix."""
    mixed = mix_channels(z, weights)
    return mixed.withColumn("phi", F.col("z_seq") + alpha * F.col("phi"))


def ltr_features(z: DataFrame, tail_rank: int = 20) -> DataFrame:
    """Adds the 21 features of the listwise model; z has rank and z-scores of all channels."""
    tail = F.when(F.col("rank") > tail_rank, 1.0).otherwise(0.0)
    tenth = F.max(F.when(F.col("rank") == 10, F.col("z_seq"))).over(pool_window())
    unpop = F.col("z_cat") * -F.col("z_pop")
    out = {
        "neg_log_rank": -F.log(F.col("rank").cast("double")), "inv_rank": 1.0 / F.col("rank"), **{f"z_{c}": F.col(f"z_{c}") for c in CHANNELS},
        "seq_gap_r10": F.coalesce(F.col("z_seq") - tenth, F.lit(0.0)), "z_cat_unpop": unpop,
        **{f"z_{c}_tail": F.col(f"z_{c}") * tail for c in ("text", "co", "hist", "last_co", "cat", "markov", "brand")}, "z_cat_unpop_tail": unpop * tail,
    }
    return z.withColumns({k: v for k, v in out.items() if not (k in z.columns)})


# The listwise features by name, in the order of their weights.
LTR_FEATURES = (
    "neg_log_rank", "inv_rank", "z_seq", "z_text", "z_co", "z_hist", "z_last_co", "z_cat", "z_pop", "z_markov", "z_brand", "seq_gap_r10", "z_cat_unpop",
    "z_text_tail", "z_co_tail", "z_hist_tail", "z_last_co_tail", "z_cat_tail", "z_markov_tail", "z_brand_tail", "z_cat_unpop_tail",
)


def fit_listwise(rows: DataFrame, features: tuple[str, ...] = LTR_FEATURES, l2: float = 0.1, steps: int = 80) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(w, mean, sd) of a softmax over each user's list: rows user_id, label (gold > 0) and the features. Users without a gold
    item are passed over. See fit_folds(); steps bounds the passes over the lists."""
    return fit_folds(rows, features, l2=l2, passes=steps)[0]


def apply_listwise(rows: DataFrame, w: np.ndarray, mu: np.ndarray, sd: np.ndarray, features: tuple[str, ...] = LTR_FEATURES) -> DataFrame:
    """Adds score: the standardised features times the weights."""
    if len(w) != len(features):
        raise ValueError(f"{len(w)} weights for {len(features)} features")
    return rows.withColumn("score", _linear(w, mu, sd, features))


def _linear(w: np.ndarray, mu: np.ndarray, sd: np.ndarray, features: tuple[str, ...]) -> Column:
    return sum(((F.col(c) - float(m)) / float(s) * float(v) for c, v, m, s in zip(features, w, mu, sd)), F.lit(0.0))


def out_of_fold(rows: DataFrame, folds: int = 5, seed: int = 42, features: tuple[str, ...] = LTR_FEATURES, l2: float = 0.1, steps: int = 80) -> DataFrame:
    """Adds score, each user's from a model that has not seen the user: folds are dealt by a hash of the user, and their models are
    fitted in the same passes."""
    found = fit_folds(rows, features, folds, l2, steps, seed)
    scores = [_linear(*m, features) for m in found]
    score = F.element_at(F.array(*scores), fold_of(folds, seed) + 1) if folds > 1 else scores[0]
    return rows.withColumn("score", score)


def rank_penalty(rank: Column, head_n: int = 20) -> Column:
    return clamp((head_n + 1 - rank) / head_n, 0.0, 1.0)


def rank_residual(rows: DataFrame, beta: float) -> DataFrame:
    return rows.withColumn("score", -F.log(F.col("rank").cast("double")) + beta * zscore(F.col("residual"), pool_window()))


def greedy_swaps(pool: DataFrame, head_n: int = 20, focus_k: int = 50, tau: float = 0.25, gamma: float = 0.0, most: int = 10) -> DataFrame:
    """pool: user_id, item, rank, phi. The list after up to `most` swaps of an item outside the head with one of the head: each time
    the pair with the greatest gain phi(challenger) - phi(head item) - tau * penalty(head place), while it is over gamma.

    Challengers are the focus_k items of the whole pool with the greatest phi (ties by rank) that are not in the head. A list
    shorter than head_n is all head. Only the head and the focus, a short list per user, are gathered; each swap depends on the one
    before. Null phi counts as 0.
    """
    size, order = F.count("*").over(pool_window()), pool_window().orderBy(F.desc("phi"), "rank")
    rows = pool.select("user_id", "item", F.col("rank").cast("int").alias("rank"), F.coalesce("phi", F.lit(0.0)).alias("phi")).withColumn("_size", size)
    rows = rows.withColumn("_nth", F.row_number().over(order))
    concerned = (F.col("rank") <= head_n) | (F.col("_nth") <= focus_k)

    def swap(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", ignore_index=True)
        phi, place = pdf["phi"].to_numpy(), pdf["rank"].to_numpy().copy()
        n = min(head_n, int(pdf["_size"].iloc[0]))
        focus = np.flatnonzero(pdf["_nth"].to_numpy() <= focus_k)
        focus = focus[np.argsort(pdf["_nth"].to_numpy()[focus])]
        for _ in range(most):
            head = np.flatnonzero(place <= n)
            head = head[np.argsort(place[head])]
            rivals = focus[place[focus] > n]
            if not len(rivals) or not len(head):
                break
            gain = phi[rivals][:, None] - phi[head][None, :] - tau * np.clip((n + 1 - place[head]) / n, 0, 1)[None, :]
            c, d = np.unravel_index(np.argmax(gain), gain.shape)  # the first of equals: by phi of the challenger, then head place
            if gain[c, d] <= gamma:
                break
            c, d = rivals[c], head[d]
            place[c], place[d] = place[d], place[c]
        return pd.DataFrame({"user_id": pdf["user_id"], "item": pdf["item"], "rank": place})

    swapped = rows.where(concerned).groupBy("user_id").applyInPandas(swap, "user_id string, item string, rank int")
    return swapped.unionByName(rows.where(~concerned).select("user_id", "item", "rank"))


def lexical_scores(pool: DataFrame, query: str = "query_tokens", doc: str = "item_tokens") -> DataFrame:
    """Adds hits (shared tokens) and text_score (their share of the query's tokens)."""
    n = F.size(F.array_intersect(query, doc))
    return pool.withColumn("hits", n).withColumn("text_score", F.coalesce(n / F.nullif(F.size(query), F.lit(0)), F.lit(0.0)))


def history_jaccard(pool: DataFrame, history: DataFrame, meta: DataFrame, column: str, last_k: int) -> DataFrame:
    """Adds score: Jaccard of the item's tokens with those of all of the user's last items. column: categories or name."""
    make = category_tokens if column == "categories" else name_tokens
    tokens = meta.select("item", make(F.col(column)).alias("_t"))
    recent = top_k(history, last_k, ["user_id"], [F.desc("ts"), F.desc("item"), F.desc("row_id")]).join(tokens, "item").groupBy("user_id").agg(F.array_distinct(F.flatten(F.collect_list("_t"))).alias("_h"))
    out = pool.join(tokens, "item", "left").join(recent, "user_id", "left")
    empty = F.array().cast("array<string>")
    return out.withColumn("score", jaccard(F.coalesce("_t", empty), F.coalesce("_h", empty))).drop("_t", "_h")


def margin_confidence(pool: DataFrame, n0: int = 5) -> DataFrame:
    """user_id, margin: the logistic of the first score minus the n0-th (the last of shorter lists)."""
    far = F.max_by("score", F.when(F.col("rank") <= n0, F.col("rank")))
    return pool.groupBy("user_id").agg(sigmoid(F.max_by("score", -F.col("rank")) - far).alias("margin"))


def alignment_confidence(margin: Column, cosine: Column, omega: float = 0.7) -> Column:
    """omega * (1 + cosine) / 2 + (1 - omega) * margin; the margin alone where there is no text vector (cosine null)."""
    return F.coalesce(omega * (1 + cosine) / 2 + (1 - omega) * margin, margin)


def confidence_window(c: Column, n0: int = 5, m0: int = 10, gamma_n: float = 3.0, gamma_m: float = 5.0, n_range=(3, 8), m_range=(8, 15)) -> list[Column]:
    """n_u, m_u: how many places are guarded and how far they may fall, by the confidence; halves are rounded to even."""
    n = F.bround(n0 + gamma_n * (1 - 2 * c)).cast("int")
    m = F.bround(m0 + gamma_m * (2 * c - 1)).cast("int")
    return [clamp(n, *n_range).cast("int").alias("n_u"), clamp(m, *m_range).cast("int").alias("m_u")]


def gate(c: Column, margin: Column, enabled: bool = True, min_c: float = 0.45, max_margin: float = 0.85) -> Column:
    """Why a reranker is called or not: ok, low_c_u or high_stage1_margin."""
    return F.when(F.lit(not enabled), "ok").when(c < min_c, "low_c_u").when(margin > max_margin, "high_stage1_margin").otherwise("ok")


def boosted(pool: DataFrame, boosts: DataFrame, scale: float = 0.05) -> DataFrame:
    """The pool by score + scale * boost, ties by item."""
    rows = pool.join(boosts.select("user_id", "item", F.col("score").alias("_b")), ["user_id", "item"], "left")
    return top_k(rows.withColumn("_s", F.col("score") + scale * F.coalesce("_b", F.lit(0.0))).drop("rank", "_b"), None, ["user_id"], [F.desc("_s"), "item"]).drop("_s")


def weighted_window(pool: DataFrame, weights: dict[str, float], cap: int) -> DataFrame:
    """The first `cap` items by the weighted z-scores of some columns, ties by phi, then item."""
    score = sum((F.lit(w) * zscore(F.coalesce(F.col(c), F.lit(0.0)), pool_window()) for c, w in weights.items()), F.lit(0.0))
    return top_k(pool.drop("rank").withColumn("score", score), cap, ["user_id"], [F.desc(F.round("score", 9)), F.desc("phi"), "item"])


def lexical_picks(pool: DataFrame, k: int, displaced_from: int, delta_in: int = 1, delta_out: int = 2, band: tuple[int, int] = (11, 40), min_hits: int = 0) -> DataFrame:
    """Items beyond the head (places over displaced_from) whose hits exceed the best of the k places that picks displace by
    delta_in within the band of places, by delta_out outside; the k best by hits, then place, then item."""
    shown = F.max(F.when((F.col("rank") <= displaced_from) & (F.col("rank") > displaced_from - k), F.col("hits"))).over(pool_window())
    delta = F.when(F.col("rank").between(*band), delta_in).otherwise(delta_out)
    need = F.when(shown.isNull(), F.greatest(F.lit(1), delta, F.lit(min_hits))).otherwise(F.greatest(F.lit(min_hits), shown + delta))
    rows = pool.withColumn("_need", need).where((F.col("rank") > displaced_from) & (F.col("hits") >= F.col("_need"))).withColumnRenamed("rank", "old")
    return top_k(rows, k, ["user_id"], [F.desc("hits"), "old", "item"]).select("user_id", "item", "rank")


def listwise_window(pool: DataFrame, cap: int, inject: int = 0) -> DataFrame:
    """pool: user_id, item, rank (by phi), stage1_rank, hits. The list that a listwise model sees, cap items: the first cap - inject
    by phi, then up to `inject` items of the rest with the most hits (one at least; ties by stage1_rank, null last, then item), then
    the rest by phi. inject is cut to cap - 1, cap to the pool's size."""
    cap = max(1, cap)
    n = F.least(F.lit(cap), F.count("*").over(pool_window()))
    rows = pool.select("user_id", "item", "rank", "stage1_rank", "hits").withColumn("_n", n)
    rows = rows.withColumn("_head", F.col("_n") - F.greatest(F.lit(0), F.least(F.lit(inject), F.col("_n") - 1)))
    rival = (F.col("rank") > F.col("_head")) & (F.coalesce("hits", F.lit(0)) >= 1)
    nth = F.row_number().over(pool_window().orderBy((~rival).cast("int"), F.desc("hits"), F.asc_nulls_last("stage1_rank"), "item"))
    rows = rows.withColumn("_nth", F.when(rival, nth))
    part = F.when(F.col("rank") <= F.col("_head"), 0).when(F.col("_nth") <= F.col("_n") - F.col("_head"), 1).otherwise(2)
    place = F.row_number().over(pool_window().orderBy(part, F.when(part == 1, F.col("_nth")).otherwise(F.col("rank"))))
    return rows.withColumn("_place", place).where(F.col("_place") <= F.col("_n")).select("user_id", "item", F.col("_place").alias("rank"))


def blend_window(window: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """window: user_id, item, rank, phi, text, co and model_rank (the model's order; items it left out, null, come last by rank).
    Order by the weighted z-scores of phi, model, text and co, ties by phi, then item. The model's score is (n + 1 - place) / n."""
    weights = {"phi": 1.0, "model": 0.0, "text": 0.0, "co": 0.0} | (weights or {})
    n = F.count("*").over(pool_window())
    place = F.row_number().over(pool_window().orderBy(F.asc_nulls_last("model_rank"), "rank"))
    rows = window.drop("model").withColumn("model", (n + 1 - place) / n)
    score = sum((F.lit(w) * zscore(F.coalesce(F.col(c), F.lit(0.0)), pool_window()) for c, w in weights.items()), F.lit(0.0))
    rows = rows.drop("rank").withColumn("_score", F.round(score, 9))
    return top_k(rows, None, ["user_id"], [F.desc("_score"), F.desc("phi"), "item"]).select("user_id", "item", "rank")


def save_listwise(spark, path: str, w: np.ndarray, mu: np.ndarray, sd: np.ndarray, features: tuple[str, ...] = LTR_FEATURES) -> None:
    """Writes a fitted listwise model, a row per feature: nth, feature, weight, mean, sd."""
    rows = [(i, f, float(a), float(b), float(c)) for i, (f, a, b, c) in enumerate(zip(features, w, mu, sd, strict=True))]
    spark.createDataFrame(rows, "nth int, feature string, weight double, mean double, sd double").coalesce(1).write.mode("overwrite").parquet(path)


def load_listwise(spark, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[str, ...]]:
    """(w, mean, sd, features) of save_listwise()."""
    rows = spark.read.parquet(path).orderBy("nth").collect()
    return (*(np.array([r[c] for r in rows], float) for c in ("weight", "mean", "sd")), tuple(r["feature"] for r in rows))


def block_report(rows: DataFrame, head_n: int = 20, focus_k: int = 50) -> DataFrame:
    """rows: user_id, item, rank, score, label. A row per user: recall at focus_k by score, the best gold place, and gold items
    of the tail (beyond head_n) that the score brings into focus."""
    placed = rows.withColumn("place", F.row_number().over(pool_window().orderBy(F.desc("score"), "rank")))
    gold = F.col("label") == 1
    return placed.groupBy("user_id").agg(
        F.count_if(gold).alias("n_gold"), (F.count_if(gold & (F.col("place") <= focus_k)) / F.nullif(F.count_if(gold), F.lit(0))).alias("recall"), F.min(F.when(gold, F.col("place"))).alias("best_place"),
        F.count_if(gold & (F.col("rank") > head_n) & (F.col("place") <= focus_k)).alias("tail_in_focus"),
        F.avg(F.when(gold & (F.col("rank") > head_n), F.col("score"))).alias("tail_gold_mean"), F.avg(F.when(F.col("rank") <= head_n, F.col("score"))).alias("head_mean"),
    )
