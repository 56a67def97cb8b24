"""The driver's tables as the library's: interactions, signals, items, vectors, triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The query time of the signal queries: 2024-01-25 00:00 UTC, in microseconds.
QUERY_TS = 1_706_140_800_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as interactions of customers with parts."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("o_custkey").cast("string").alias("user_id"), F.col("l_partkey").cast("string").alias("item"), (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("rating"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.round(F.col("l_tax") * 100).cast("int").alias("helpful_vote"), (F.col("l_returnflag") != "R").alias("verified"), F.expr("(l_orderkey * 8 + l_linenumber) * 1000000 + l_suppkey % 1000 * 1000 + cast(round(l_extendedprice * 100) as bigint) % 1000").alias("row_id"),
    )


def as_signals(events: DataFrame) -> DataFrame:
    """Events, of a table or a stream, as aspect signals of users about items."""
    polarity = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "click", 0.5).when(F.col("event_type") == "signup", 0.25).when(F.col("event_type") == "error", -1.0).otherwise(0.0)
    return events.select(
        F.col("user_id").cast("string").alias("user_id"), F.get_json_object("props", "$.k").alias("item"), F.concat(F.lit("a"), (F.col("event_id") % 8).cast("string")).alias("aspect"), polarity.alias("polarity"),
        F.floor("value").cast("int").alias("helpful"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("row_id"),
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_signals(table(spark, sf_dir, "events"))


def queries_at(signal: DataFrame, ts: int = QUERY_TS) -> DataFrame:
    return signal.select("user_id").distinct().withColumn("query_ts", F.lit(ts).cast("long"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("item"), F.col("p_name").alias("name"), F.concat("p_type", F.lit(", "), "p_brand").alias("categories"), F.col("p_retailprice").alias("price"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("item"), F.col("embedding").alias("vector"), "label")


def triples(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """Lines of orders as triples of reviews (orders); with a shift, another annotator's."""
    n = F.col("l_partkey") + shift * (F.col("l_linenumber") % 3)
    aspect = F.element_at(F.array(*map(F.lit, ("smell", "Scent ", "price", "fit", "packaging", "texture", "colour", "size"))), (n % 8 + 1).cast("int"))
    sentiment = F.element_at(F.array(*map(F.lit, ("positive", "negative", "neutral"))), ((F.col("l_suppkey") + shift * (F.col("l_linenumber") % 2)) % 3 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("review_id"), aspect.alias("aspect"), sentiment.alias("sentiment"), (0.4 + F.col("l_discount") * 5).alias("confidence"))
