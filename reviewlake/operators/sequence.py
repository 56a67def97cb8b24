"""Order-aware operators: transitions, histories, time scales, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import DAY_US, clamp
from ..functions.session import save
from .ranking import top_k

USER_ORDER = ("ts", "item", "row_id")


def _next(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(*USER_ORDER)
    return rows.select("user_id", F.col("item").alias("prev"), F.lead("item").over(w).alias("next")).where("next is not null")


def transitions(rows: DataFrame) -> DataFrame:
    """prev, next, n: how often users went from one item to the next, repeats of one item included."""
    return _next(rows).groupBy("prev", "next").agg(F.count("*").alias("n"))


def markov_probabilities(rows: DataFrame) -> DataFrame:
    """prev, next, p: the next item's probability, an item that follows itself left out."""
    n = transitions(rows).where("prev <> next")
    return n.select("prev", "next", (F.col("n") / F.sum("n").over(Window.partitionBy("prev"))).alias("p"))


def last_items(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg(F.max_by("item", F.struct(*USER_ORDER)).alias("prev"))


def next_item_scores(candidates: DataFrame, train: DataFrame) -> DataFrame:
    """candidates: user_id, item. Adds score: transitions from the user's last item, or the item's popularity where that item
    (or the user) has no transitions."""
    n = transitions(train)
    popular = train.groupBy("item").agg(F.count("*").alias("_pop"))
    has = n.select("prev").distinct().withColumn("_has", F.lit(True))
    last = last_items(train).join(has, "prev", "left")
    rows = candidates.join(last, "user_id", "left").join(n.withColumnRenamed("next", "item"), ["prev", "item"], "left").join(popular, "item", "left")
    score = F.when(F.col("_has"), F.coalesce("n", F.lit(0))).otherwise(F.coalesce("_pop", F.lit(0))).cast("double")
    return rows.select(*candidates.columns, score.alias("score"))


def next_item_hits(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """user_id, item, score: transitions from the user's last item; and user_id of those whose last item has any."""
    n = save(transitions(train).withColumnRenamed("prev", "_prev"), "transitions")
    met = last_items(train).join(n, F.col("prev") == F.col("_prev")).select("user_id", F.col("next").alias("item"), F.col("n").cast("double").alias("score"))
    return met, met.select("user_id").distinct()


def _markov_steps(rows: DataFrame, last_k: int, decay: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The probabilities, the users' last items that have any with their weights, and the users' sums of weights."""
    w = Window.partitionBy("user_id").orderBy(*(F.desc(c) for c in USER_ORDER))
    recent = rows.withColumn("_age", F.row_number().over(w) - 1).where(F.col("_age") < last_k).select("user_id", F.col("item").alias("prev"), F.pow(F.lit(decay), F.col("_age")).alias("_w"))
    p = save(markov_probabilities(rows), "probabilities")
    recent = recent.join(p.select("prev").distinct(), "prev", "left_semi")
    return p.withColumnRenamed("next", "item"), recent, recent.groupBy("user_id").agg(F.sum("_w").alias("_total"))


def markov_hits(rows: DataFrame, last_k: int = 3, decay: float = 0.6) -> DataFrame:
    """user_id, item, score as in markov_scores(), wherever it is not 0."""
    p, recent, total = _markov_steps(rows, last_k, decay)
    hit = recent.join(p, "prev").groupBy("user_id", "item").agg(F.sum(F.col("_w") * F.col("p")).alias("_sum"))
    return hit.join(total, "user_id").select("user_id", "item", (F.col("_sum") / F.col("_total")).alias("score"))


def markov_scores(candidates: DataFrame, rows: DataFrame, last_k: int = 3, decay: float = 0.6) -> DataFrame:
    """candidates: user_id, item. Adds score: next-item probabilities from the user's last items, weighted by decay ** age and
    averaged over those of them that have any."""
    p, recent, total = _markov_steps(rows, last_k, decay)
    hit = candidates.select("user_id", "item").join(recent, "user_id").join(p, ["prev", "item"]).groupBy("user_id", "item").agg(F.sum(F.col("_w") * F.col("p")).alias("_sum"))
    out = candidates.join(hit, ["user_id", "item"], "left").join(total, "user_id", "left")
    return out.select(*candidates.columns, F.coalesce(F.col("_sum") / F.col("_total"), F.lit(0.0)).alias("score"))


def time_scale(rows: DataFrame, unit_us: int | None = None) -> DataFrame:
    """user_id, scale: the least gap over 0 between a user's rows in order, 1 without one; or the fixed unit."""
    if unit_us is not None:
        return rows.select("user_id").distinct().withColumn("scale", F.lit(unit_us).cast("long"))
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy("user_id").orderBy(*USER_ORDER))
    return rows.withColumn("_gap", gap).groupBy("user_id").agg(F.coalesce(F.min(F.when(F.col("_gap") > 0, F.col("_gap"))), F.lit(1)).alias("scale"))


def normalized_events(rows: DataFrame, unit_us: int | None = None) -> DataFrame:
    """Adds norm_ts: 1 + the time since the user's first row in units of the time scale, halves rounded to even."""
    first = F.min("ts").over(Window.partitionBy("user_id"))
    out = rows.withColumn("_first", first).join(time_scale(rows, unit_us), "user_id")
    return out.withColumn("norm_ts", F.bround((F.col("ts") - F.col("_first")) / F.col("scale")).cast("long") + 1).drop("_first", "scale")


def user_sequences(rows: DataFrame, ids: DataFrame, unit_us: int | None = None, least: int = 2) -> DataFrame:
    """user_id, events: array of (local, norm_ts) in order, of users with `least` known items; unknown items go after scaling."""
    known = normalized_events(rows, unit_us).join(ids.select(F.col("id").alias("item"), "local"), "item")
    events = F.transform(F.sort_array(F.collect_list(F.struct(*USER_ORDER, "local", "norm_ts"))), lambda e: F.struct(e["local"].alias("local"), e["norm_ts"].alias("norm_ts")))
    return known.groupBy("user_id").agg(events.alias("events")).where(F.size("events") >= least)


def time_matrix(times: Column, span: int = 256) -> Column:
    """Array of arrays: the distances of all pairs of times, at most span."""
    return F.transform(times, lambda x: F.transform(times, lambda y: F.least(F.abs(x - y), F.lit(span))))


def padded(items: Column, maxlen: int, left: bool = True) -> Column:
    """The last maxlen entries, filled with zeros on the left (or right)."""
    kept = F.slice(items, -F.least(F.size(items), F.lit(maxlen)), F.lit(maxlen))
    kept = F.when(F.size(items) == 0, items).otherwise(kept)
    zeros = F.array_repeat(F.lit(0).cast("long"), maxlen - F.size(kept))
    return F.concat(zeros, kept) if left else F.concat(kept, zeros)


def prefix_history(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Each row that has earlier ones of its user: row_id, user_id, item, ts, history (those items in order, the last `most`)."""
    w = Window.partitionBy("user_id").orderBy(*USER_ORDER).rowsBetween(Window.unboundedPreceding if most is None else -most, -1)
    return rows.withColumn("history", F.collect_list("item").over(w)).where(F.size("history") > 0).select("row_id", "user_id", "item", "ts", "history")


def prefix_events(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """The rows of a user strictly before each query (user_id, query_ts)."""
    return rows.join(queries.select("user_id", "query_ts"), "user_id").where(F.col("ts") < F.col("query_ts"))


def prefix_reviews(rows: DataFrame, queries: DataFrame, texts: DataFrame) -> DataFrame:
    """user_id, query_ts, reviews: a user's own review texts before the query, in order, blank ones left out."""
    joined = prefix_events(rows, queries).join(texts.select("user_id", "item", "ts", "text"), ["user_id", "item", "ts"]).where("trim(text) <> ''")
    ordered = F.sort_array(F.collect_list(F.struct(*USER_ORDER, "text")))
    return joined.groupBy("user_id", "query_ts").agg(F.transform(ordered, lambda r: r["text"]).alias("reviews"))


def asof_text(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """queries: user_id, query_ts; texts: user_id, ts, text. Adds text: that of the latest entry at or before the query; where
    it is empty, that of the user's first entry; null without entries."""
    at = texts.select("user_id", F.col("ts").alias("_ts"), F.col("text").alias("_text"))
    found = queries.select("user_id", "query_ts").distinct().join(at, "user_id").groupBy("user_id", "query_ts").agg(
        F.max_by(F.when(F.col("_ts") <= F.col("query_ts"), F.col("_text")), F.when(F.col("_ts") <= F.col("query_ts"), F.col("_ts"))).alias("_asof"), F.min_by("_text", "_ts").alias("_first")
    )
    text = F.coalesce(F.when(F.col("_asof") != "", F.col("_asof")), F.col("_first"))
    return queries.join(found, ["user_id", "query_ts"], "left").withColumn("text", text).drop("_asof", "_first")


def align_rows(train: DataFrame, texts: DataFrame) -> DataFrame:
    """Every row of a user but the first, with the text kept for exactly its time."""
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy(*USER_ORDER))
    later = train.withColumn("_pos", pos).where("_pos > 1").drop("_pos")
    return later.join(texts.select("user_id", "ts", "text"), ["user_id", "ts"])


def day_index(ts: Column, first: Column) -> Column:
    return F.floor((ts - first) / DAY_US)


def time_bucket(source_day: Column, target_day: Column, length: int = 240) -> Column:
    """Relative day, centred, within 0 .. length - 1."""
    return clamp(target_day - source_day + length // 2, 0, length - 1).cast("int")


def node_days(rows: DataFrame, key: str) -> DataFrame:
    """key, day: the last day of each node since the table's first row, 0 at least."""
    first = rows.agg(F.min("ts").alias("_first"))
    days = rows.join(F.broadcast(first)).groupBy(key).agg(F.max(day_index(F.col("ts"), F.col("_first"))).alias("day"))
    return days.withColumn("day", F.greatest("day", F.lit(0)))


def history_affinity(candidates: DataFrame, rows: DataFrame, vectors: DataFrame, decay: float = 0.9, last_k: int = 50) -> DataFrame:
    """candidates: user_id, item. Adds score: mean cosine with the user's last items, weighted by decay ** age; items without a
    vector are passed over, the weights of the rest counting in full."""
    from ..functions.columns import cosine

    recent = top_k(rows, last_k, ["user_id"], [F.desc(c) for c in USER_ORDER]).select("user_id", F.col("item").alias("_h"), F.pow(F.lit(decay), F.col("rank") - 1).alias("_w"))
    recent = recent.join(vectors.select(F.col("item").alias("_h"), F.col("vector").alias("_hv")), "_h")
    met = candidates.select("user_id", "item").join(vectors, "item").join(recent, "user_id")
    score = met.groupBy("user_id", "item").agg((F.sum(F.col("_w") * cosine(F.col("vector"), F.col("_hv"))) / F.sum("_w")).alias("score"))
    return candidates.join(score, ["user_id", "item"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
