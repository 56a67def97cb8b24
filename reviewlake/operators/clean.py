"""Cleaning and splitting of interactions: user_id, item, rating, ts, helpful_vote, verified, row_id (row_id breaks ties)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import save


written = save  # k_core() has a parameter of that name


def in_period(rows: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows with ts in the closed interval; None leaves a side open."""
    for bound, keep in ((low, F.col("ts") >= F.lit(low)), (high, F.col("ts") <= F.lit(high))):
        rows = rows if bound is None else rows.where(keep)
    return rows


def dedup_earliest(rows: DataFrame, keys: tuple[str, ...] = ("user_id", "item")) -> DataFrame:
    """The earliest row of each key; of equal times the first by row_id. One shuffle, map-side reduced."""
    others = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*others), F.struct("ts", "row_id")).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*rows.columns)


def k_core(rows: DataFrame, k: int, save=None, max_rounds: int = 100) -> DataFrame:
    """Drops rows of users or items with fewer than k rows, both counted on the same state, until none is left to drop.

    save: cuts the lineage of a round (a function DataFrame -> DataFrame); by default it is written to the folder that the cluster
    shares. What goes is written too, so that Spark knows when it is small enough for a join without a shuffle of the rows.
    """
    if k <= 1:
        return rows
    keep = save or (lambda df: written(df, "core"))
    rows = keep(rows)
    n = rows.count()
    for _ in range(max_rounds):
        users, items = (keep(rows.groupBy(c).count().where(F.col("count") < k).select(c)) for c in ("user_id", "item"))
        rows = keep(rows.where("user_id is not null and item is not null").join(users, "user_id", "left_anti").join(items, "item", "left_anti"))
        left = rows.count()
        if left == n:
            return rows
        n = left
    raise RuntimeError("the k-core did not settle")


def k_core_summary(rows: DataFrame) -> DataFrame:
    """One row: n_rows, n_users, n_items, min_user_degree, min_item_degree; zeros for an empty table."""
    u = rows.groupBy("user_id").count().agg(F.count("*").alias("n_users"), F.min("count").alias("min_user_degree"))
    i = rows.groupBy("item").count().agg(F.count("*").alias("n_items"), F.min("count").alias("min_item_degree"), F.sum("count").alias("n_rows"))
    return u.join(i).select(*(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_rows", "n_users", "n_items", "min_user_degree", "min_item_degree")))


def cap_by_degree(rows: DataFrame, key: str, most: int, order: Column | None = None) -> DataFrame:
    """Rows of the `most` keys with the most rows; ties by a seeded hash of the key. The cap is a top-k, so it is merged
    from the tasks' own best and only `most` keys are kept."""
    order = F.xxhash64(F.lit(42), F.col(key)) if order is None else order
    top = rows.groupBy(key).count().orderBy(F.desc("count"), order, key).limit(most).select(key)
    return rows.join(top, key, "left_semi")


def sample_subset(rows: DataFrame, k: int, most_users: int | None, most_items: int | None, save=None) -> DataFrame:
    """The k-core, items capped, then users, the k-core restored after each cap."""
    rows = k_core(rows, k, save)
    for key, most in (("item", most_items), ("user_id", most_users)):
        if most is not None:
            rows = k_core(cap_by_degree(rows, key, most), k, save)
    return rows


def with_position(rows: DataFrame) -> DataFrame:
    """pos: 1, 2, ... in a user's order of time, then item; n: the user's rows."""
    user = Window.partitionBy("user_id")
    return rows.withColumn("pos", F.row_number().over(user.orderBy("ts", "item", "row_id"))).withColumn("n", F.count("*").over(user))


def chronological_split(rows: DataFrame, train: float = 0.8, valid: float = 0.1, test: float = 0.1, min_history: int = 0) -> DataFrame:
    """split: train, valid or test. Each user's first int(n * train) rows, the next int(n * valid), the rest.

    Users whose train part is shorter than min_history, or who would lack one of the parts, are train as a whole.
    """
    if abs(train + valid + test - 1.0) > 1e-6:
        raise ValueError("the ratios must sum to 1.0")
    rows = with_position(rows)
    n_train, n_valid = F.floor(F.col("n") * F.lit(train)), F.floor(F.col("n") * F.lit(valid))
    whole = (n_train < min_history) | (n_train < 1) | (n_valid < 1) | (F.col("n") - n_train - n_valid < 1)
    split = F.when(whole | (F.col("pos") <= n_train), "train").when(F.col("pos") <= n_train + n_valid, "valid").otherwise("test")
    return rows.withColumn("split", split).drop("pos", "n")


def leave_last_out(rows: DataFrame, min_history: int = 0) -> DataFrame:
    """split: a user's last row is test, the one before valid, if there are 3 rows at least and min_history before them."""
    rows = with_position(rows)
    enough = (F.col("n") >= 3) & (F.col("n") - 2 >= min_history)
    split = F.when(enough & (F.col("pos") == F.col("n")), "test").when(enough & (F.col("pos") == F.col("n") - 1), "valid").otherwise("train")
    return rows.withColumn("split", split).drop("pos", "n")


def split_manifest(split: DataFrame) -> DataFrame:
    """For each part: n_rows, n_users, n_items, first and last time, the percentage of verified rows."""
    return split.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("n_users"), F.count_distinct("item").alias("n_items"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.round(100 * F.avg(F.col("verified").cast("double")), 4).alias("pct_verified"),
    )


def part(split: DataFrame, name: str) -> DataFrame:
    return split.where(F.col("split") == name).drop("split")


def history_scope(split: DataFrame, mode: str = "train") -> DataFrame:
    """What may be known at test time: the train rows, or with mode train_valid the valid rows too."""
    return split.where(F.col("split").isin(*(["train", "valid"] if mode == "train_valid" else ["train"])))


def in_train_scope(reviews: DataFrame, train: DataFrame) -> DataFrame:
    """Reviews whose user and whose item occur in train (not necessarily together) and that are not later than train's last row."""
    last = train.agg(F.coalesce(F.max("ts"), F.lit(0)).alias("_last"))
    kept = reviews.join(train.select("user_id").distinct(), "user_id", "left_semi").join(train.select("item").distinct(), "item", "left_semi")
    return kept.join(F.broadcast(last)).where("ts <= _last").drop("_last")  # one row


def review_index(reviews: DataFrame, train: DataFrame) -> DataFrame:
    """review_id, user_id, item, ts in train's scope; of repeated ids the last row."""
    last = F.max_by(F.struct("user_id", "item", "ts"), "row_id").alias("_r")
    return in_train_scope(reviews, train).groupBy("review_id").agg(last).select("review_id", "_r.*")


def export_targets(reviews: DataFrame, train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets, counters): review_id and text to extract from, first row per id, no blank texts; and what was left out why."""
    users, items = train.select("user_id", F.lit(True).alias("_u")).distinct(), train.select("item", F.lit(True).alias("_i")).distinct()
    last = train.agg(F.coalesce(F.max("ts"), F.lit(0)).alias("_last"))
    rows = reviews.join(users, "user_id", "left").join(items, "item", "left").join(F.broadcast(last))
    scoped = F.coalesce(F.col("_u") & F.col("_i") & (F.col("ts") <= F.col("_last")), F.lit(False))
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    rows = rows.select("review_id", "text", "row_id", scoped.alias("scoped"), blank.alias("blank"))
    first = F.min_by("text", "row_id").alias("text")
    targets = rows.where("scoped and not blank").groupBy("review_id").agg(first)
    counters = rows.agg(
        F.count("*").alias("scanned"), F.count_if(F.expr("scoped")).alias("in_scope"), F.count_if(F.expr("scoped and blank")).alias("blank"), F.count_if(F.expr("not scoped")).alias("out_of_scope"),
        F.count_distinct(F.when(F.expr("scoped and not blank"), F.col("review_id"))).alias("written"),
    ).withColumn("duplicates", F.col("in_scope") - F.col("blank") - F.col("written"))
    return targets, counters


def numbered(rows: DataFrame, order: list[Column | str], name: str = "local") -> DataFrame:
    """rows with their place in an order, from 1 without gaps.

    The numbering is global but no task sorts all rows: they are dealt into ranges, and a range's numbers start after the
    number of rows in the ranges before it.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    ranged = save(ranged, "ranged")  # a lost executor must not deal other ranges for the second use
    ranged = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").select(*rows.columns, (F.col("_before") + F.col("_nth")).alias(name))


def id_maps(*frames: DataFrame, column: str = "item") -> DataFrame:
    """id, local: all ids of the frames in order, numbered from 1 without gaps (0 is for padding)."""
    ids = frames[0].select(F.col(column).alias("id"))
    for f in frames[1:]:
        ids = ids.union(f.select(F.col(column).alias("id")))
    return numbered(ids.where("id is not null").distinct(), ["id"])


def cases_by_user(test: DataFrame, verified_only: bool = False) -> DataFrame:
    """user_id, relevant (the distinct items), query_ts (the last), n_rows: one case per user of the test rows."""
    rows = test.where("verified") if verified_only else test
    return rows.groupBy("user_id").agg(F.sort_array(F.collect_set("item")).alias("relevant"), F.max("ts").alias("query_ts"), F.count("*").alias("n_rows"))
