"""The heterogeneous graph as tables: nodes (id, kind, key), edges (src, dst, relation, weight, bucket)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .catalogue import running_sums
from .clean import id_maps
from .sequence import day_index, node_days, time_bucket
from .signals import interest_scores

REVERSED = {"reviewed": "reviewed_by", "has_sentiment": "sentiment_of", "prefers": "preferred_by"}


def nodes(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """id, kind, key: users first, then items, then aspects, numbered from 0 through all three."""
    users, items = id_maps(rows, column="user_id"), id_maps(rows, column="item")
    n = users.agg(F.count("*").alias("n_users")).join(items.agg(F.count("*").alias("n_items")))
    part = lambda df, kind, shift: df.join(F.broadcast(n)).select((F.col("local") - 1 + shift).cast("long").alias("id"), F.lit(kind).alias("kind"), F.col("id").alias("key"))
    aspects = vocabulary.select(F.col("aspect").alias("id"), (F.col("id") + 1).alias("local"))
    return part(users, "user", F.lit(0)).union(part(items, "item", F.col("n_users"))).union(part(aspects, "aspect", F.col("n_users") + F.col("n_items")))


def edges(rows: DataFrame, sentiment: DataFrame, gammas: DataFrame) -> DataFrame:
    """src_kind, src, dst_kind, dst, relation, weight, bucket: three relations and their reverses, by key.

    bucket: the days between the two ends' last activity, centred. Preference edges carry their weight.
    """
    first = F.broadcast(rows.agg(F.min("ts").alias("_f"), F.max("ts").alias("_l")))
    users, items = node_days(rows, "user_id"), node_days(rows, "item")
    end = day_index(F.col("_l"), F.col("_f"))
    seen = rows.groupBy("user_id", "item").agg(F.max("ts").alias("ts")).join(users, "user_id").withColumnRenamed("day", "ud").join(items, "item").withColumnRenamed("day", "vd")
    a = seen.select(F.lit("user").alias("src_kind"), F.col("user_id").alias("src"), F.lit("item").alias("dst_kind"), F.col("item").alias("dst"), F.lit("reviewed").alias("relation"), F.lit(1.0).alias("weight"), time_bucket(F.col("ud"), F.col("vd")).alias("bucket"))
    b = sentiment.join(items, "item").join(first).select(F.lit("item").alias("src_kind"), F.col("item").alias("src"), F.lit("aspect").alias("dst_kind"), F.col("aspect").alias("dst"), F.lit("has_sentiment").alias("relation"), F.col("score").alias("weight"), time_bucket(F.col("day"), end).alias("bucket"))
    c = gammas.join(users, "user_id").join(first).select(F.lit("user").alias("src_kind"), F.col("user_id").alias("src"), F.lit("aspect").alias("dst_kind"), F.col("aspect").alias("dst"), F.lit("prefers").alias("relation"), F.col("gamma").alias("weight"), time_bucket(F.col("day"), end).alias("bucket"))
    forward = a.unionByName(b).unionByName(c)
    back = F.when(F.lit(False), F.lit(""))
    for k, v in REVERSED.items():
        back = back.when(F.col("relation") == k, F.lit(v))
    reverse = forward.select(F.col("dst_kind").alias("src_kind"), F.col("dst").alias("src"), F.col("src_kind").alias("dst_kind"), F.col("src").alias("dst"), back.alias("relation"), "weight", (F.lit(240) - F.col("bucket")).alias("bucket"))
    return forward.unionByName(reverse.withColumn("bucket", F.least("bucket", F.lit(239))))


def preference_edges(signals: DataFrame, cutoff: int, rate: float = 0.01) -> DataFrame:
    """user_id, aspect, gamma: what users feel about aspects just after the cutoff; what comes to nothing is left out."""
    queries = signals.select("user_id").distinct().withColumn("query_ts", F.lit(cutoff + 1).cast("long"))
    return interest_scores(signals, queries, rate).where(F.abs("gamma") >= 1e-9).select("user_id", "aspect", "gamma")


def neighbourhood(sentiment: DataFrame, most: int = 32) -> DataFrame:
    """item, aspect, weight, nth: each item's strongest aspects, |score| + 0.1, at most `most`."""
    w = F.abs("score") + 0.1
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("weight"), "aspect"))
    return sentiment.select("item", "aspect", w.alias("weight")).withColumn("nth", nth).where(F.col("nth") <= most)


def padded_adjacency(edges_: DataFrame, n_nodes: int, width: int = 32) -> DataFrame:
    """edges: node, other, weight, ids from 1. node (0 to n_nodes), neighbours, weights and mask (arrays of `width`, filled with 0),
    degree, cut (edges left out) and start (where the node's entries begin in the list of all kept ones).

    A node keeps its `width` heaviest neighbours, the smaller id first among equals; tasks cut hot nodes' edges down to that before
    the shuffle. Row 0 is that of padding.
    """
    order = Window.partitionBy("node").orderBy(F.desc("weight"), "other")
    kept = edges_.select("node", "other", "weight").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= width)
    lists = kept.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("nth", F.col("other").cast("long").alias("other"), F.col("weight").cast("double").alias("weight")))).alias("found"))
    many = edges_.groupBy("node").agg(F.count("*").alias("edges"))
    nodes_ = edges_.sparkSession.range(n_nodes + 1).withColumnRenamed("id", "node")
    rows = nodes_.join(lists, "node", "left").join(many, "node", "left").withColumn("degree", F.coalesce(F.size("found"), F.lit(0)).cast("long"))
    rows = rows.withColumn("degree", F.when(F.col("found").isNull(), 0).otherwise(F.col("degree")).cast("long")).withColumn("_all", F.lit(0))
    placed = running_sums(rows, ["_all"], ["node"], "degree", "upto")
    fill = lambda c, zero: F.concat(F.coalesce(F.transform("found", lambda e: e[c]), F.array().cast(f"array<{zero}>")), F.array_repeat(F.lit(0).cast(zero), F.lit(width) - F.col("degree").cast("int")))
    mask = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (i <= F.col("degree")).cast("int"))
    return placed.select("node", fill("other", "bigint").alias("neighbours"), fill("weight", "double").alias("weights"), mask.alias("mask"), "degree", (F.coalesce("edges", F.lit(0)) - F.col("degree")).alias("cut"), (F.col("upto") - F.col("degree")).alias("start"))


def aspect_adjacency(sentiment: DataFrame, items: DataFrame, vocabulary: DataFrame, width: int = 32) -> tuple[DataFrame, DataFrame]:
    """(items to aspects, aspects to items) as padded_adjacency(); weights are |score| + 0.1. items: id, local (from 1); vocabulary:
    aspect, id (from 0). Items that have no number are left out, unknown aspects count as the one named other, if there is one."""
    local = vocabulary.select("aspect", (F.col("id") + 1).alias("_aspect"))
    other = F.broadcast(local.agg(F.max(F.when(F.col("aspect") == "other", F.col("_aspect"))).alias("_other")))
    rows = sentiment.join(items.select(F.col("id").alias("item"), F.col("local").alias("_item")), "item").join(local, "aspect", "left").join(other)
    pairs = rows.select("_item", F.coalesce("_aspect", "_other").alias("_aspect"), (F.abs("score") + 0.1).alias("weight")).where("_aspect is not null")
    sides = []
    for node, far, count in (("_item", "_aspect", items.count()), ("_aspect", "_item", vocabulary.count())):
        sides.append(padded_adjacency(pairs.select(F.col(node).alias("node"), F.col(far).alias("other"), "weight"), count, width))
    return sides[0], sides[1]


def neighbour_mean(edges_: DataFrame, vectors: DataFrame, key: str = "item", other: str = "aspect") -> DataFrame:
    """key, vector: the weighted mean of the neighbours' vectors. Dimensions are summed apart, so no task holds a node's neighbours."""
    long = edges_.join(vectors.select(F.col("key").alias(other), F.posexplode("vector").alias("dim", "x")), other)
    mean = long.groupBy(key, "dim").agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("x"))
    return mean.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vector"))


def known_pairs(rows: DataFrame, train: DataFrame) -> DataFrame:
    """The rows whose user and item are both known from train."""
    return rows.join(train.select("user_id").distinct(), "user_id", "left_semi").join(train.select("item").distinct(), "item", "left_semi")
