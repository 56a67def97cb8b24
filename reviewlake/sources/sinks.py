"""Sinks: split tables with a manifest, converted dumps, keyed caches with upserts, result tables and run fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import split_manifest


def write_split(split: DataFrame, path: str) -> DataFrame:
    """Parquet by part, and a manifest of a row per part; returns the manifest."""
    split.write.mode("overwrite").partitionBy("split").parquet(f"{path}/rows")
    written = split.sparkSession.read.parquet(f"{path}/rows")
    split_manifest(written).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return split.sparkSession.read.json(f"{path}/manifest")


def write_json_split(split: DataFrame, path: str) -> None:
    """A folder of line-delimited files per part, times in milliseconds, for tools that read those."""
    out = split.select("split", "user_id", "item", "rating", F.expr("ts div 1000").alias("timestamp"), "helpful_vote", F.col("verified").alias("verified_purchase"))
    out.write.mode("overwrite").partitionBy("split").json(path)


def convert_reviews(reviews: DataFrame, path: str, keep: DataFrame | None = None, most: int | None = None) -> int:
    """Normalised reviews of kept items (item) as lines; `most` counts written rows. Returns how many were written."""
    rows = reviews if keep is None else reviews.join(keep.select("item").distinct(), "item", "left_semi")
    if most is not None:
        rows = rows.orderBy("row_id").limit(most)
    rows.drop("row_id").write.mode("overwrite").json(path)
    return reviews.sparkSession.read.schema("user_id string").json(path).count()


def select_businesses(meta: DataFrame, cities: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """Venues in one of the cities (any case) whose categories contain one of the words."""
    rows = meta
    if cities:
        rows = rows.where(F.lower("store").isin(*(c.lower() for c in cities)))
    if categories:
        text = F.lower(F.array_join("categories", ", "))
        found = F.lit(False)
        for c in categories:
            found = found | text.contains(c.lower())
        rows = rows.where(found)
    return rows


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys; of repeated keys in new the last by row_id, if it has one."""
    if "row_id" in new.columns:
        others = F.struct(*(c for c in new.columns if c not in keys))
        new = new.groupBy(*keys).agg(F.max_by(others, "row_id").alias("_n")).select(*keys, "_n.*").select(*[c for c in old.columns])
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def without_keys(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys), keys, "left_anti")


def merged_shards(main: DataFrame, shards: DataFrame, keys: list[str], overwrite: bool = False) -> DataFrame:
    """main and the shards' rows of new keys; with overwrite the shards' rows win."""
    return upserted(main, shards, keys) if overwrite else main.unionByName(shards.join(main.select(*keys), keys, "left_anti").select(*main.columns))


def check_version(spark: SparkSession, path: str, version: str) -> None:
    """Writes the version beside a new cache, and refuses a cache of another version or of none."""
    note = f"{path.rstrip('/')}_version"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    there = [fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p)) for p in (path, note)]
    if there[1]:
        found = spark.read.text(note).first()[0]
        if found != version:
            raise ValueError(f"{path} was written by {found}, not {version}")
    elif there[0]:
        raise ValueError(f"{path} has no version")
    else:
        spark.createDataFrame([(version,)], "value string").coalesce(1).write.text(note)


def pending(work: DataFrame, done: DataFrame, key: str = "row_key") -> DataFrame:
    """Work that a resumed run still has to do."""
    return work.join(done.select(key), key, "left_anti")


def result_tables(metrics: DataFrame, names: list[str], method: str, unit: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """(values, summary): method, unit, metric, value in long form, and the means."""
    long = metrics.unpivot([unit], names, "metric", "value").withColumn("method", F.lit(method))
    return long, long.groupBy("method", "metric").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


def fingerprint(table: DataFrame) -> DataFrame:
    """One row: n_rows and a digest of all rows in any order, so that two runs can be compared."""
    cells = F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(table.columns)))
    return table.agg(F.count("*").alias("n_rows"), F.hex(F.bit_xor(F.xxhash64(cells))).alias("digest"))


def run_id(config: dict) -> str:
    """16 hex digits for a configuration."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def write_typed_tsv(split: DataFrame, path: str) -> None:
    """All parts as one typed TSV, each user's rows in order; a task writes a range of users, in seconds."""
    rows = split.select(F.col("user_id").alias("user_id:token"), F.col("item").alias("item_id:token"), F.col("rating").alias("rating:float"), (F.col("ts") / 1e6).alias("timestamp:float"))
    ordered = rows.repartitionByRange("user_id:token").sortWithinPartitions("user_id:token", "timestamp:float", "item_id:token")
    ordered.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def duplicate_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that should be unique and are not: keys, n."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def report_html(summary: dict, aspects: list[tuple[str, int]]) -> str:
    """A page with bars for the most frequent aspects; both come aggregated."""
    from html import escape

    top = max((n for _, n in aspects), default=1)
    bars = "".join(f'<tr><td>{escape(a)}</td><td><div style="background:#48a;width:{300 * n // top}px">{n}</div></td></tr>' for a, n in aspects[:12])
    return f"<html><body><h1>Extraction</h1><p>{escape(json.dumps(summary))}</p><table>{bars}</table></body></html>"
