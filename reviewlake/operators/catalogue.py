"""Lists and places over a whole catalogue, without users times catalogue.

A model gives most items of a user a default score, in an order that many users share, and a few items a score of their own:
those with an edge from the user's history. So the best items are the best of those few and of a short prefix of the default order,
and an item's exact place is a number in the default order, corrected by the user's own and excluded items ahead of it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import save
from .ranking import top_k

PLAIN = "plain"
#: Places of each default order that every task gets; two bases are usual.
NEAR = 10_000


class SparseScores(NamedTuple):
    """hits: user_id, item, score, each pair once. orders: base, item, score, the default scores of the whole catalogue under each
    base. bases: user_id, base of the users whose base is not PLAIN, or None. Equal scores stand in the order of the items."""

    hits: DataFrame
    orders: DataFrame
    bases: DataFrame | None = None


def flat_order(rows: DataFrame, score: float = 0.0, base: str = PLAIN) -> DataFrame:
    """Every item of rows at one score."""
    return rows.select(F.lit(base).alias("base"), "item", F.lit(score).cast("double").alias("score")).distinct()


def running_sums(rows: DataFrame, group: list[str], order: list[str | Column], value: str, out: str) -> DataFrame:
    """rows with the sum of value over the rows of their group up to and with their own, in an order; sums are longs.

    Neither a group nor all rows meet in one task: rows are dealt into ranges of (group, order), each range is summed for itself,
    and where a group goes on from an earlier range, what was before is added. Only those are joined, one for a range at most.
    """
    ranged = save(rows.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    within = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy("_range", *group).agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    later = sums.withColumn("_before", before).where("_before is not null").drop("_sum")
    out_rows = ranged.withColumn("_own", F.sum(value).over(within)).join(F.broadcast(later), ["_range", *group], "left")
    return out_rows.select(*rows.columns, (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("long").alias(out))


def _with_base(users: DataFrame, model: SparseScores) -> DataFrame:
    if model.bases is None:
        return users.withColumn("base", F.lit(PLAIN))
    return users.join(model.bases.select("user_id", "base"), "user_id", "left").withColumn("base", F.coalesce("base", F.lit(PLAIN)))


def _placed(model: SparseScores) -> DataFrame:
    """base, item, score, place: from 1, by falling score and then by item."""
    rows = model.orders.select("base", "item", "score", F.lit(1).alias("_one"))
    return running_sums(rows, ["base"], [F.desc("score"), "item"], "_one", "place").drop("_one")


def best(model: SparseScores, users: DataFrame, k: int | None, excluded: DataFrame | None = None) -> DataFrame:
    """user_id, item, score, rank: each user's k best items of the catalogue (None: all of it, in order), ties by item, without
    excluded ones (user_id, item).

    A user's defaults among the k best lie within the first k + (own and excluded items) places of the order. Users are joined by
    place with just so many, so rows made are in proportion to k, hits and exclusions; the catalogue's length never enters. The
    first NEAR places, which all users share, are sent to every task; only places beyond are joined by a shuffle. Defaults,
    own items and exclusions then meet by one shuffle by user.
    """
    users = _with_base(users.select("user_id").distinct(), model)
    hits = save(model.hits.join(users.select("user_id"), "user_id", "left_semi").select("user_id", "item", "score"), "hits")
    none = F.lit(None).cast("double")
    marked = [hits.select("user_id", "item", none.alias("_plain"), F.col("score").cast("double").alias("_own"), F.lit(False).alias("_out"))]
    if excluded is not None:
        marked.append(excluded.select("user_id", "item", none.alias("_plain"), none.alias("_own"), F.lit(True).alias("_out")))
    if k is None:
        marked.append(users.join(model.orders, "base").select("user_id", "item", F.col("score").alias("_plain"), none.alias("_own"), F.lit(False).alias("_out")))
    else:
        off = hits.select("user_id") if excluded is None else hits.select("user_id").unionAll(excluded.select("user_id"))
        many = off.groupBy("user_id").agg(F.count("*").alias("_off"))
        upto = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k) + F.coalesce("_off", F.lit(0))))
        places = users.join(many, "user_id", "left").select("user_id", "base", upto.alias("place"))
        order = save(_placed(model), "order")
        near, far = F.col("place") <= NEAR, F.col("place") > NEAR
        for met in (places.where(near).join(F.broadcast(order.where(near)), ["base", "place"]), places.where(far).join(order.where(far), ["base", "place"])):
            marked.append(met.select("user_id", "item", F.col("score").alias("_plain"), none.alias("_own"), F.lit(False).alias("_out")))
    rows = marked[0]
    for part in marked[1:]:
        rows = rows.unionByName(part)
    rows = rows.repartition("user_id").groupBy("user_id", "item").agg(F.max("_plain").alias("_plain"), F.max("_own").alias("_own"), F.bool_or("_out").alias("_out"))
    rows = rows.where("not _out and coalesce(_own, _plain) is not null").select("user_id", "item", F.coalesce("_own", "_plain").alias("score"))
    return top_k(rows, k, ["user_id"], [F.desc("score"), "item"])


def _completed(model: SparseScores, gold: DataFrame, missing: float) -> tuple[SparseScores, DataFrame]:
    """The model with gold items that neither the catalogue nor the hits have as hits of score `missing`; gold with base."""
    rows = _with_base(gold.select("user_id", "item").distinct(), model)
    hits = save(model.hits.join(gold.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "item", F.col("score").cast("double").alias("score")), "hits")
    new = rows.join(model.orders.select("base", "item"), ["base", "item"], "left_anti").join(hits.select("user_id", "item"), ["user_id", "item"], "left_anti")
    return model._replace(hits=hits.unionByName(save(new.select("user_id", "item", F.lit(missing).cast("double").alias("score")), "new"))), rows


def with_gold(model: SparseScores, gold: DataFrame, missing: float = 0.0) -> SparseScores:
    """The model under which each user's gold items (user_id, item) are in the running even if the catalogue lacks them."""
    return _completed(model, gold, missing)[0]


def score_pairs(model: SparseScores, pairs: DataFrame, missing: float = 0.0) -> DataFrame:
    """pairs (user_id, item, ...) with score: the user's own, else the default, else `missing`."""
    base = F.lit(PLAIN) if model.bases is None else F.coalesce("base", F.lit(PLAIN))
    rows = pairs if model.bases is None else pairs.join(model.bases.select("user_id", "base"), "user_id", "left")
    rows = rows.withColumn("base", base).join(model.hits.select("user_id", "item", F.col("score").alias("_hit")), ["user_id", "item"], "left").join(model.orders.select("base", "item", F.col("score").alias("_plain")), ["base", "item"], "left")
    return rows.select(*pairs.columns, F.coalesce("_hit", "_plain", F.lit(missing)).cast("double").alias("score"))


def defaults_ahead(model: SparseScores, rows: DataFrame) -> DataFrame:
    """rows (user_id, item, base, score, each pair once) with ahead: the default items that come before the score and item."""
    # Asked pairs have mark 0 and come before what equals them in score and item: their own entry is not ahead of them.
    user = F.lit(None).cast(rows.schema["user_id"].dataType).alias("user_id")
    order = model.orders.select("base", "score", "item", F.lit(1).alias("mark"), user, F.lit(1).alias("one"))
    asked = rows.select("base", "score", "item", F.lit(0).alias("mark"), "user_id", F.lit(0).alias("one"))
    return running_sums(order.unionByName(asked), ["base"], [F.desc("score"), "item", "mark"], "one", "ahead").where("mark = 0").select("user_id", "item", "base", "score", "ahead")


def gold_places(model: SparseScores, gold: DataFrame, excluded: DataFrame | None = None, missing: float = 0.0, together: bool = True) -> DataFrame:
    """user_id, item, score, rank of each gold pair (user_id, item): its exact place among the user's items of the catalogue, by
    falling score and then by item.

    Excluded pairs (user_id, item) don't take part. Together, gold ones always do, and those that the catalogue lacks are in
    it with the score `missing`; else that holds for each gold pair's own place only, as if it were the user's only one.
    The place is 1 + the default items ahead + the user's own items ahead - the defaults ahead that the user's own score or an
    exclusion takes out of the order. The first is one running sum over the order and all gold pairs, the other two are one over
    each user's rows, so work grows with catalogue, hits, gold and exclusions, never with their products.
    """
    if together:
        model, _ = _completed(model, gold, missing)
    else:
        model = model._replace(hits=save(model.hits.join(gold.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "item", "score"), "hits"))
    rows = save(_with_base(score_pairs(model, gold.select("user_id", "item").distinct(), missing), model), "gold")
    users = rows.select("user_id", "base").distinct()
    ahead = defaults_ahead(model, rows)
    hits = model.hits.join(users, "user_id").select("user_id", "base", "item", "score")
    off = hits.select("user_id", "base", "item")
    if excluded is not None:
        out = excluded.select("user_id", "item").join(users, "user_id").select("user_id", "base", "item")
        out = out.join(rows.select("user_id", "item"), ["user_id", "item"], "left_anti").select(*out.columns) if together else out
        hits = hits.join(out.select("user_id", "item"), ["user_id", "item"], "left_anti")
        off = off.unionByName(out).distinct()
    own = hits.select("user_id", "score", "item", F.lit(1).alias("mark"), F.lit(1).alias("one"))
    gone = off.join(model.orders, ["base", "item"]).select("user_id", "score", "item", F.lit(1).alias("mark"), F.lit(-1).alias("one"))
    asked = rows.select("user_id", "score", "item", F.lit(0).alias("mark"), F.lit(0).alias("one"))
    moved = running_sums(own.unionByName(gone).unionByName(asked), ["user_id"], [F.desc("score"), "item", "mark"], "one", "moved").where("mark = 0")
    both = ahead.select("user_id", "item", "score", "ahead").join(moved.select("user_id", "item", "moved"), ["user_id", "item"])
    return both.select("user_id", "item", "score", (F.col("ahead") + F.col("moved") + 1).alias("rank"))
