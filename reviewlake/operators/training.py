"""Padded training batches of next-item models, the same ones however the rows are partitioned."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash32
from ..functions.session import save
from .clean import numbered
from .sequence import normalized_events, padded

USER_ORDER = ("ts", "item", "row_id")
#: Draws of the first round for a position; each further round has twice as many for the positions that are left.
DRAWS = 4


def training_batches(rows: DataFrame, ids: DataFrame, maxlen: int = 50, batch_size: int = 256, epoch: int = 0, seed: int = 42, unit_us: int | None = None) -> DataFrame:
    """batch, nth, user_id, seq, times, positive, negative: one row for each user with two known items or more.

    rows: interactions; ids: id, local (items numbered from 1 without gaps, 0 is padding). Users are put into the epoch's order,
    by a hash of seed, epoch and user, and cut into batches. seq: the local ids of the last maxlen events but the very last, filled
    with 0 on the left; positive: the event after each; times: normalised times; negative: for each an item that the user has
    never had, drawn by hashes until one is found, 0 for users who have had all items.
    """
    events = normalized_events(rows, unit_us).join(ids.select(F.col("id").alias("item"), F.col("local").cast("long").alias("local")), "item")
    back = Window.partitionBy("user_id").orderBy(*(F.desc(c) for c in USER_ORDER))
    last = events.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= maxlen + 1).select("user_id", "_back", "local", "norm_ts")
    steps = last.withColumn("positive", F.lag("local").over(Window.partitionBy("user_id").orderBy("_back"))).where("_back > 1")
    steps = save(steps.select("user_id", (F.col("_back") - 1).cast("long").alias("step"), "local", "norm_ts", "positive"), "steps")
    negatives = draw_unseen(steps.select("user_id", "step"), events.select("user_id", "local").distinct(), ids.count(), seed, epoch)
    whole = steps.join(negatives, ["user_id", "step"], "left").withColumn("negative", F.coalesce("negative", F.lit(0).cast("long")))
    lists = whole.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("step")).alias("at"), "local", "norm_ts", "positive", "negative"))).alias("e"))
    part = lambda c: padded(F.transform("e", lambda x: x[c]), maxlen)
    made = lists.select("user_id", part("local").alias("seq"), part("norm_ts").alias("times"), part("positive").alias("positive"), part("negative").alias("negative"))
    order = numbered(made.select("user_id", hash32(F.lit(seed), F.lit(epoch), "user_id").alias("_h")), ["_h", "user_id"], "place").select("user_id", (F.col("place") - 1).alias("_p"))
    size = F.lit(batch_size)
    return made.join(order, "user_id").select(F.expr(f"_p div {batch_size}").alias("batch"), (F.col("_p") % size).alias("nth"), "user_id", "seq", "times", "positive", "negative")


def draw_unseen(positions: DataFrame, seen: DataFrame, n_items: int, seed: int, epoch: int) -> DataFrame:
    """positions: user_id, step; seen: user_id, local, each once. Adds negative: the first of the draws 0, 1, 2 ... for the position
    that the user has not had. Positions of users who have had all n_items are left out; nobody's items are gathered anywhere."""
    full = seen.groupBy("user_id").count().where(F.col("count") >= n_items).select("user_id")
    left, found, low, many = positions.join(full, "user_id", "left_anti"), None, 0, DRAWS
    while True:
        tries = left.withColumn("j", F.explode(F.sequence(F.lit(low), F.lit(low + many - 1))))
        drawn = tries.withColumn("local", (1 + hash32(F.lit(seed), F.lit(epoch), "user_id", "step", "j") % n_items).cast("long"))
        first = drawn.join(seen, ["user_id", "local"], "left_anti").groupBy("user_id", "step").agg(F.min_by("local", "j").alias("negative"))
        first = save(first, "drawn")
        found = first if found is None else found.unionByName(first)
        left = save(left.join(first, ["user_id", "step"], "left_anti"), "left")
        if left.isEmpty():
            return found
        low, many = low + many, 2 * many
