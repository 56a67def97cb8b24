"""A corpus pipeline of five stages: quality, line dedup, near duplicates, mixing, and pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's docs. All
but the last return the columns of documents. Stages decide by doc_id: rows that share an id share their fate, and rows
without an id stay as they are. Texts are only shuffled where a decision concerns them. Further columns come along through all
stages but the last, whatever their names; null texts count as empty, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import parted, save, table
from reviewlake.llm.line_dedup import WHOLE, line_dedup
from reviewlake.llm.mixing import mix_sources
from reviewlake.llm.ngram_join import ngram_jaccard
from reviewlake.llm.piece_nbest import encode_nbest
from reviewlake.llm.quality import score_quality

PIECES = "piece_bpe_32k.model"


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without those whose doc_id is in ids."""
    maybe, never = parted(docs, ids, "doc_id")
    return never.unionByName(maybe.join(ids, "doc_id", "left_anti").select(*docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking puts above the quantile of label 0."""
    scored = score_quality(docs, table(spark, sf_dir, "labels"))
    return _without(docs, save(scored.where("predicted = 0 and doc_id is not null").select("doc_id").distinct(), "rejected"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose template recurs; n_chars follows the text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    # One column for all others, so that none of them clashes with a name that the operator uses.
    held = docs.select("doc_id", "text", F.struct(F.lit(0), *(F.col(f"`{c}`") for c in others)).alias("_row"))
    cut = line_dedup(held, carry=("_row",), **WHOLE)
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text")}
    return cut.select(*(own.get(f.name, F.col("_row").getField(f.name)).cast(f.dataType).alias(f.name) for f in docs.schema))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id."""
    found = ngram_jaccard(docs)
    return _without(docs, save(found.where("component_id <> doc_id").select("doc_id").distinct(), "copies"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those that it doesn't take go."""
    copies = save(mix_sources(docs).where("copies <> 1 and doc_id is not null").groupBy("doc_id").agg(F.max("copies").alias("copies")), "copies")
    maybe, never = parted(docs, copies, "doc_id")
    # The same plan at every size: texts are always dealt by id here, as the table of copies grows with the corpus.
    taken = copies.withColumnRenamed("copies", "_rl_copies").hint("merge")
    times = maybe.join(taken, "doc_id", "left").withColumn("_rl_nth", F.explode(F.expr("if(_rl_copies = 0, array(), sequence(1, coalesce(_rl_copies, 1)))")))
    return never.unionByName(times.drop("_rl_copies", "_rl_nth").select(*never.columns))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, rank, score, n_pieces, ids: the two best segmentations of each text."""
    return encode_nbest(docs, public_tokenizers.path(PIECES), 2)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("pieces", pieces)]
#: SQL has no training, no template tree and no piece lattice; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
