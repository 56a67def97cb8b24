"""Mixing sources to target weights: a low-discrepancy schedule over sources, joined with shuffled blocks of equal size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, running_start, save

#: The golden ratio's fraction times 2 ** 32, made odd: multiples of it modulo 2 ** 32 are a low-discrepancy sequence.
GOLDEN = 2654435769
CELLS = 4096
MAX_REPEATS = 3


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes: source_key, source_size. Adds weight and target, in words.

    Weights are 1, 2, 3, repeating, by source_key. Targets share the total by weight and stop at MAX_REPEATS times the
    source's size; the excess goes to the others by weight. In the order of size per weight the first k sources are at their
    stop and the rest share what is left at one level; the level is the first that leaves its own source below the stop.
    """
    whole, each = Window.partitionBy(), Window.orderBy("source_key")
    w = sizes.withColumn("weight", ((F.row_number().over(each) - 1) % 3 + 1).cast("double")).withColumn("stop", MAX_REPEATS * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("stop") / F.col("weight"), "source_key")
    left = F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    w = w.withColumn("level", left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))).withColumn("nth", F.row_number().over(order))
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.struct("nth", "level"))).over(whole)["level"]
    return w.withColumn("target", F.least("stop", F.col("weight") * F.coalesce(first, F.lit(0.0)))).drop("stop", "level", "nth")


def schedule(sources: DataFrame, n_slots: int) -> DataFrame:
    """slot, source_key, nth: which source each slot takes, and its rank among that source's slots from 0.

    sources: source_key and share (of all slots). Slot j's point, j times the golden ratio modulo 1, falls into one source's
    interval of the cumulative shares; the interval is found by an equality join on cells of the unit interval.
    """
    spark = sources.sparkSession
    upto = F.sum("share").over(Window.orderBy("source_key"))
    spans = sources.where("share > 0").select("source_key", (upto - F.col("share")).alias("low"), upto.alias("high"))
    last = Window.orderBy(F.desc("source_key"))
    spans = spans.withColumn("high", F.when(F.row_number().over(last) == 1, F.lit(2.0)).otherwise(F.col("high")))
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.floor(F.least(F.col("high"), F.lit(1.0)) * CELLS))))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), F.expr(f"(id % 2147483648L) * {GOLDEN}L % 4294967296L / 4294967296D").alias("point"))
    hit = slots.withColumn("cell", F.floor(F.col("point") * CELLS)).join(cells, "cell").where("point >= low and point < high")
    hit = hit.select("slot", "source_key").withColumn("chunk", F.floor(F.col("slot") / 4096))
    before = Window.partitionBy("source_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = hit.groupBy("source_key", "chunk").count().select("source_key", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("source_key", "chunk").orderBy("slot")
    return hit.join(chunks, ["source_key", "chunk"]).select("slot", "source_key", (F.col("start") + F.row_number().over(within) - 1).alias("nth"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 1024, least_blocks: int = 256, seed: int = 17) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, copies.

    A document's size is its number of words; null and empty texts have 0 and are taken 0 times. A null source is a source of
    its own, the last. Each source's documents are put in the order of a seeded hash of their id (ties by id, then size; rows
    equal in all three are interchangeable) and cut into blocks of `block_words` words, or of fewer words where a source would
    have under `least_blocks` blocks. The schedule's n-th slot of a source takes its block n modulo the number of blocks, at most
    MAX_REPEATS times each. taken: the words of the document in the blocks taken, repeats counted. copies: taken by size,
    rounded, or 1 for a document without words. The result depends on the rows alone, not on how they are partitioned.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    base = save(base.withColumn("source_key", key).withColumn("order", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed))), "sizes")
    totals = base.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_rows, n_words = int(totals[0]), int(totals[1])
    block_words = max(block_words, n_words >> 28)  # at most 2 ** 28 slots or so, well within the sequence's period
    sources = source_targets(base.groupBy("source_key").agg(F.sum("size").alias("source_size")))
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("source_size") / least_blocks))).cast("long"))
    sources = sources.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")))
    sources = save(sources.withColumn("slots", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)), "sources")
    n_slots = round(sources.agg(F.coalesce(F.sum("slots"), F.lit(0.0))).first()[0])
    shares = sources.select("source_key", (F.col("slots") / max(n_slots, 1)).alias("share"))
    plan = schedule(shares, n_slots).join(sources.select("source_key", "blocks"), "source_key").where(f"nth < {MAX_REPEATS} * blocks")
    uses = plan.groupBy("source_key", (F.col("nth") % F.col("blocks")).alias("nth_block")).agg(F.count("*").alias("uses"))
    placed = save(running_start(base, ["source_key"], "order", ["doc_id", "size"], "size", n_rows, "start").join(sources.select("source_key", "source_size", "target", "block"), "source_key").withColumn("row", F.monotonically_increasing_id()), "placed")
    parts = placed.where("size > 0").withColumn("nth_block", F.explode(F.expr("sequence(start div block, (start + size - 1) div block)")))
    words = F.expr("least(start + size, (nth_block + 1) * block) - greatest(start, nth_block * block)")
    taken = parts.join(uses, ["source_key", "nth_block"]).groupBy("row").agg(F.sum(words * F.col("uses")).alias("taken"))
    taken_words = F.coalesce("taken", F.lit(0)).cast("long")
    return placed.join(taken, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target", taken_words.alias("taken"), F.when(F.col("size") > 0, F.round(taken_words / F.col("size"))).otherwise(1).cast("int").alias("copies")
    )
