"""A log of results by shards: a run that was stopped goes on where it was, and only under the same configuration."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


class ShardLogError(RuntimeError):
    """The log's configuration is missing or another one."""


class ShardLog:
    """Under path: config (the configuration that the rows belong to), rows/<shard> and commits (shard, n_rows, digest).

    A shard's rows are written first, over what an interrupted run may have left, and its commit after them, so a shard is there
    as a whole or not at all; rows without a commit are never read. Everything goes through Spark's readers and writers, so
    path may be in any store.
    """

    def __init__(self, spark: SparkSession, path: str, config: dict, shards: int = 64, resume: bool = True):
        self.spark, self.path, self.shards = spark, path.rstrip("/"), shards
        self.config = json.dumps({"version": VERSION, "shards": shards, **config}, sort_keys=True, default=str)
        stored, committed = self._config(), self.commits()
        if not resume or (stored is None and not committed):
            spark.createDataFrame([], "shard int, n_rows long, digest string").write.mode("overwrite").parquet(f"{self.path}/commits")
            spark.createDataFrame([(self.config,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/config")
        elif stored is None:
            raise ShardLogError(f"{path} has commits but no configuration")
        elif stored != self.config:
            raise ShardLogError(f"{path} belongs to {stored}, not {self.config}")

    def _config(self) -> str | None:
        try:
            found = self.spark.read.text(f"{self.path}/config").collect()
        except AnalysisException:
            return None
        return found[0].value if found else None

    def commits(self) -> dict[int, tuple[int, str]]:
        """shard to (n_rows, digest), of finished shards."""
        try:
            found = self.spark.read.schema("shard int, n_rows long, digest string").parquet(f"{self.path}/commits").collect()
        except AnalysisException:
            return {}
        return {r.shard: (r.n_rows, r.digest) for r in found}

    def pending(self) -> list[int]:
        done = self.commits()
        return [s for s in range(self.shards) if s not in done]

    def run(self, work: DataFrame, key: str, evaluate: Callable[[DataFrame], DataFrame], most: int | None = None) -> int:
        """Evaluates the pending shards of work, `most` of them at most, one job after the other; returns how many it did.

        Rows are dealt by a hash of the key, so all rows of a key are in one shard, and in the same one in each run.
        """
        todo = self.pending()[:most]
        for shard in todo:
            part = work.where(F.pmod(F.xxhash64(key), F.lit(self.shards)) == shard)
            target = f"{self.path}/rows/{shard}"
            evaluate(part).write.mode("overwrite").parquet(target)
            rows = self.spark.read.parquet(target)
            cells = F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(rows.columns)))
            n, digest = rows.agg(F.count("*"), F.coalesce(F.hex(F.bit_xor(F.xxhash64(cells))), F.lit(""))).first()
            self.spark.createDataFrame([(shard, n, digest)], "shard int, n_rows long, digest string").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return len(todo)

    def read(self) -> DataFrame:
        """The rows of all finished shards; ShardLogError if there is none."""
        done = sorted(self.commits())
        if not done:
            raise ShardLogError(f"{self.path} has no finished shard")
        return self.spark.read.parquet(*(f"{self.path}/rows/{s}" for s in done))
