"""Items that the same users met: co-visit edges and item-based collaborative filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import save
from .factors import Factors


#: Items of one user that meet in one task.
BLOCK = 2000


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys into all shuffle partitions: a join that makes many rows of few would else run in the few tasks that its
    input's size suggests."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _pairs(left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """anchor, co, n: users that have anchor on the left and co on the right. A user's items meet only each other, and partial
    counts are made before the shuffle by edge. Users with many items are dealt into blocks, each pair of which is a task's key,
    so that no task has more than some block * block pairs of a user; no pair is left out."""
    a = left.select("user_id", F.col("item").alias("anchor")).distinct()
    b = right.select("user_id", F.col("item").alias("co")).distinct()
    blocks = F.ceil(F.greatest(F.count("*"), F.lit(1)) / block).cast("int")
    many = a.select("user_id").unionAll(b.select("user_id")).groupBy("user_id").agg(blocks.alias("_blocks")).where("_blocks > 1")
    own = lambda item: F.pmod(F.xxhash64(item), F.coalesce("_blocks", F.lit(1))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1))
    a = _spread(a.join(many, "user_id", "left").select("user_id", "anchor", own("anchor").alias("_a"), every.alias("_b")), "user_id", "_a", "_b")
    b = _spread(b.join(many, "user_id", "left").select("user_id", "co", own("co").alias("_b"), every.alias("_a")), "user_id", "_a", "_b")
    return a.join(b, ["user_id", "_a", "_b"]).where("anchor <> co").groupBy("anchor", "co").agg(F.count("*").alias("n"))


def covisit_edges(rows: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """anchor, co, n: the number of users with both. With texts (user_id, item, text) only items that a user wrote about are
    anchors, so edges need not be symmetric."""
    wrote = rows if texts is None else rows.join(texts.where("trim(text) <> ''").select("user_id", "item").distinct(), ["user_id", "item"], "left_semi")
    return _pairs(wrote, rows)


def coitem_scores(anchors: DataFrame, pool: DataFrame, edges: DataFrame) -> DataFrame:
    """anchors: user_id, item (repeats count); pool: user_id, item. user_id, item, score: edges from the anchors, summed and
    divided by the user's greatest sum; only items with an edge.

    Anchors are dealt by user, so where Spark sends the edges to every task (they are saved, so it knows their size) a user's
    rows are summed where they are made."""
    own = anchors.select("user_id", F.col("item").alias("anchor")).repartition("user_id").groupBy("user_id", "anchor").agg(F.count("*").alias("_times"))
    met = own.join(save(edges, "edges"), "anchor").groupBy("user_id", F.col("co").alias("item")).agg(F.sum(F.col("n") * F.col("_times")).alias("n"))
    summed = met.join(pool.select("user_id", "item").distinct(), ["user_id", "item"], "left_semi")
    return summed.select("user_id", "item", (F.col("n") / F.max("n").over(Window.partitionBy("user_id"))).alias("score"))


def item_similarity(rows: DataFrame) -> DataFrame:
    """anchor, co, similarity: cosine of the items' sets of users, an item with itself (1) included."""
    d = rows.select("user_id", "item").distinct()
    size = d.groupBy("item").agg(F.count("*").alias("_n"))
    edges = _pairs(d, d).join(size.select(F.col("item").alias("anchor"), F.col("_n").alias("_na")), "anchor").join(size.select(F.col("item").alias("co"), F.col("_n").alias("_nb")), "co")
    other = edges.select("anchor", "co", (F.col("n") / F.sqrt(F.col("_na") * F.col("_nb"))).alias("similarity"))
    return other.unionByName(size.select(F.col("item").alias("anchor"), F.col("item").alias("co"), F.lit(1.0).alias("similarity")))


def itemknn_hits(rows: DataFrame) -> DataFrame:
    """user_id, item, score: the summed similarity to the user's items, wherever it is not 0. As in coitem_scores(), sums are made
    where a user's rows are, if Spark sends the similarities to every task."""
    d = rows.select("user_id", F.col("item").alias("anchor")).repartition("user_id").distinct()
    return d.join(save(item_similarity(rows), "similar"), "anchor").groupBy("user_id", F.col("co").alias("item")).agg(F.sum("similarity").alias("score"))


def itemknn_scores(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """candidates: user_id, item. Adds score: the summed similarity to the user's items; 0 for unknown users and items."""
    return candidates.join(itemknn_hits(rows), ["user_id", "item"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def _als(rows: DataFrame, user_ids: DataFrame, item_ids: DataFrame, factors: int, seed: int):
    from pyspark.ml.recommendation import ALS

    users = user_ids.select(F.col("id").alias("user_id"), F.col("local").cast("int").alias("_u"))
    items = item_ids.select(F.col("id").alias("item"), F.col("local").cast("int").alias("_i"))
    seen = rows.select("user_id", "item").distinct().join(users, "user_id").join(items, "item").withColumn("_one", F.lit(1.0))
    return ALS(rank=factors, userCol="_u", itemCol="_i", ratingCol="_one", implicitPrefs=True, seed=seed, coldStartStrategy="nan").fit(seen), users, items


def als_factors(rows: DataFrame, user_ids: DataFrame, item_ids: DataFrame, factors: int = 64, seed: int = 42) -> Factors:
    """The same factorisation's vectors, for whole catalogues (factor_best)."""
    model, users, items = _als(rows, user_ids, item_ids, factors, seed)
    vectors = lambda ids, number, found: ids.join(found.withColumnRenamed("id", number), number).select(ids.columns[0], F.col("features").cast("array<double>").alias("vector"))
    return Factors(vectors(users, "_u", model.userFactors), vectors(items, "_i", model.itemFactors), [])


def als_scores(candidates: DataFrame, rows: DataFrame, user_ids: DataFrame, item_ids: DataFrame, factors: int = 64, seed: int = 42) -> DataFrame:
    """candidates: user_id, item. Adds score from a factorisation of the 0/1 matrix by Spark's alternating least squares; unknown
    users and items score 0."""
    model, users, items = _als(rows, user_ids, item_ids, factors, seed)
    scored = model.transform(candidates.join(users, "user_id", "left").join(items, "item", "left").na.fill(0, ["_u", "_i"]))
    return scored.select(*candidates.columns, F.coalesce(F.nanvl(F.col("prediction").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("score"))
