"""What the operators of this subpackage share: reading, scratch tables and distributed running totals."""

from __future__ import annotations

import tempfile
import uuid
from typing import NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the contracts: maximal runs of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: Bit maps have 16 bits for each id at least, within these bounds; the greatest is 32 MB.
LEAST_BITS, MOST_BITS = 20, 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, null texts as empty ones; further columns, whatever their names, are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


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
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/reviewlake/{uuid.uuid4().hex}/{name}"


def save(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Cuts the lineage: writes df as a table in the shared folder and reads that, so a lost executor costs no recomputation.

    The shuffle files behind the table are of no more use. Spark deletes them when the driver's garbage is collected, which
    a driver with little to do puts off for long, so that is asked for here where the driver runs in this process's JVM.
    """
    path = scratch(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    jvm = getattr(df.sparkSession.sparkContext, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(saved: DataFrame) -> None:
    """Deletes the files of a table that save() made and that nothing reads any more, by writing an empty one over it."""
    path = saved.inputFiles()
    if path:
        saved.sparkSession.createDataFrame([], saved.schema).write.mode("overwrite").parquet(path[0].rsplit("/", 1)[0])


class BitMap(NamedTuple):
    """A filter of ids: their hashes modulo 2 ** bits as set bits, in pieces of 4 KB: _rl_piece, _rl_map."""

    bits: int
    pieces: DataFrame


def bit_map(keep: DataFrame, id_col: str) -> BitMap | None:
    """The filter of a saved table's ids, whose rows are counted first: 16 bits for each id at least, 32 MB at most, so about one
    other id in 16 or fewer passes it. None for more ids than 2 ** MOST_BITS / 4: a map would hold back too little."""
    n = keep.count()
    if n > 1 << (MOST_BITS - 2):
        return None
    size = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    bits = keep.select(F.pmod(F.xxhash64(id_col), F.lit(1 << size)).alias("_rl_bit"))
    return BitMap(size, bits.groupBy(F.expr("_rl_bit div 32768").alias("_rl_piece")).agg(F.bitmap_construct_agg(F.col("_rl_bit") % 32768).alias("_rl_map")))


def probed(rows: DataFrame, bits: BitMap | None, id_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose id may be in the filter, and those whose id surely is not; the map, of 32 MB at most, is broadcast.

    Without a filter all rows with an id are possible ones, and the join that follows shuffles them all: only costs differ.
    """
    if bits is None:
        return rows.where(F.col(id_col).isNotNull()), rows.where(F.col(id_col).isNull())
    bit = F.pmod(F.xxhash64(id_col), F.lit(1 << bits.bits))
    joined = rows.withColumn("_rl_bit", bit).withColumn("_rl_piece", F.expr("_rl_bit div 32768")).join(F.broadcast(bits.pieces), "_rl_piece", "left")
    byte = "cast(conv(hex(substring(_rl_map, cast(_rl_bit % 32768 div 8 as int) + 1, 1)), 16, 10) as int)"
    maybe = F.coalesce(F.expr(f"shiftright({byte}, cast(_rl_bit % 8 as int)) & 1 = 1"), F.lit(False)) & F.col(id_col).isNotNull()
    return tuple(joined.where(c).drop("_rl_piece", "_rl_map", "_rl_bit") for c in (maybe, ~maybe))


def parted(rows: DataFrame, keep: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose id may be among keep's ids, and those whose id surely is not: what a join of keep needs, and what it doesn't.
    keep should be a saved table, see bit_map()."""
    return probed(rows, bit_map(keep, id_col), id_col)


def narrow(rows: DataFrame, keep: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is among keep's ids, and perhaps some others: a semi-join without a shuffle of rows."""
    return parted(rows, keep, id_col)[0]


def running_start(df: DataFrame, group: list[str], order_hash: str, ties: list[str], value: str, rows: int, out: str) -> DataFrame:
    """The sum of `value` over the rows of the same group that come before, in the order of a 64-bit hash and then `ties`.

    No group is sorted in one task: its rows are dealt into hash ranges of about 2,000 rows, ranges are summed first, and
    each row adds the total of the ranges before its own to the running sum within its own.
    """
    bits = max(0, (max(rows, 1) // 2048).bit_length())
    # Ranges follow the unsigned order of the hash, and so must the rows within them.
    unsigned = F.col(order_hash).bitwiseXOR(F.lit(-(2**63)))
    cell: Column = F.shiftrightunsigned(F.col(order_hash), 64 - bits) if bits else F.lit(0).cast("long")
    df = df.withColumn("_cell", cell).withColumn("_order", unsigned)
    sums = df.groupBy(*group, "_cell").agg(F.sum(value).alias("_cell_sum"))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, "_cell", F.coalesce(F.sum("_cell_sum").over(before), F.lit(0)).alias("_cell_start"))
    within = Window.partitionBy(*group, "_cell").orderBy("_order", *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(starts, [*group, "_cell"])
        .withColumn(out, F.col("_cell_start") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("_cell", "_order", "_cell_start")
    )


def cell_bounds(values: DataFrame, rows: int, most: int = 1 << 16) -> list[float]:
    """Numbers that cut the values (one column, v, of doubles) into cells of about `rows` rows, `most` cells at most.

    They are quantiles of the distinct values whose hash is small, eight or so for each cell, so what comes to the driver has a
    bound. They only deal the work: every value has its cell, and equal values share one.
    """
    n = values.count()
    cells = min(most, n // max(rows, 1))
    if cells < 2:
        return []
    rate = min(1 << 32, 8 * cells * (1 << 32) // n + 1)
    found = values.where("v is not null").where(F.pmod(F.xxhash64("v", F.lit(7)), F.lit(1 << 32)) < rate).distinct().toPandas()["v"].sort_values()
    step = max(1, len(found) // cells)
    return [float(v) for v in found.iloc[step::step][: most - 1]]


def with_cell(rows: DataFrame, value: Column, bounds: list[float]) -> DataFrame:
    """rows with `cell`, the number of bounds that are not above the value; a null value's cell is the last one, of its own."""
    if not bounds:
        return rows.withColumn("cell", F.when(value.isNull(), 1).otherwise(0))
    cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="_rl_value", outputCol="_rl_cell", handleInvalid="keep")
    cells = cut.transform(rows.withColumn("_rl_value", F.coalesce(value, F.lit(float("nan")))))
    return cells.withColumn("cell", F.col("_rl_cell").cast("int")).drop("_rl_value", "_rl_cell")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected links (a, b): rows (node, component), the component being its smallest node.

    Labels spread along the links and then jump to their label's label, so long chains take a logarithmic number of
    steps. Two steps are a round, which is a written table and settled if its second step changed nothing; nothing is gathered
    on the driver but that. Nodes without links don't appear.
    """
    both = save(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")

    def step(labels: DataFrame) -> DataFrame:
        at = labels.withColumnRenamed("node", "b")
        near = both.join(at, "b").groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("met"))
        jump = labels.select(F.col("node").alias("met"), F.col("label").alias("far"))
        return met.join(jump, "met", "left").select("node", F.col("label").alias("old"), F.least("met", F.coalesce("far", "met")).alias("label"))

    labels = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node")
    for _ in range(max_rounds):
        new = save(step(step(labels).select("node", "label")), "labels")
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("labels did not settle")
