"""What operators ask of the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Where it is unset, as in tests on one machine, a temporary folder is set, once; on a cluster that is an error, as no local
    folder is seen by all.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="reviewlake-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads that, so several uses and lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/reviewlake/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
