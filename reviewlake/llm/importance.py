"""Target-distribution importance resampling over hashed word n-grams, which word-id suffix arrays enumerate.

Each slice of a partition numbers its words, sorts the suffixes of all its texts by their first words, and reads n-grams off as runs
of suffixes whose longest common prefix has n words at least. A run's n-gram is hashed once, and its bucket goes back to all places
where the n-gram starts.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cell_bounds, save, texts, with_cell
from .kernels import flat, slices

#: Bytes of words, after A-Z have been lower-cased: digits, a-z and all of characters outside ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True
LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[65:91] += 32


def word_ids(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The id of each word of a slice's texts in order, the words by id, and where each text's words start (the last: their number)."""
    low = LOWER_BYTE[data]
    inside = WORD_BYTE[low]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < len(data)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=before[1:])
    offsets = np.append(before[starts], before[-1])
    packed = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])])
    coded = packed.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary.to_pylist(), np.searchsorted(starts, at)


def suffix_array(ids: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """The places of ids, ordered by the ids from there to the text's end (ends: one for each place), as far as `depth` of them.

    Ranks by 1, 2, 4, ... ids are made from each other by prefix doubling; a text's end comes before any id.
    """
    order = np.argsort(ids, kind="stable")
    rank, have = ids + 1, 1
    here = np.arange(len(ids))
    while have < depth:
        behind = np.zeros(len(ids), np.int64)
        more = here + have < ends
        behind[more] = rank[here[more] + have]
        key = rank * (int(rank.max(initial=0)) + 1) + behind
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], np.diff(key[order]) != 0]))[: len(ids)]
        have *= 2
    return order


def common_prefixes(ids: np.ndarray, ends: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many ids, `depth` at most, each suffix shares with the one before it in the order; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), bool)
    for k in range(depth if len(order) > 1 else 0):
        same &= (a + k < ends[a]) & (b + k < ends[b])
        same[same] = ids[a[same] + k] == ids[b[same] + k]
        out[1:] += same
    return out


def bucket_places(ids: np.ndarray, words: list[bytes], edge: np.ndarray, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n up to `longest`: the places where an n-gram starts, and its bucket: crc32 of its words, joined by spaces."""
    ends = np.repeat(edge[1:], np.diff(edge))
    order = suffix_array(ids, ends, longest)
    shared = common_prefixes(ids, ends, order, longest)
    for n in range(1, longest + 1):
        whole = order + n <= ends[order]
        places, opens = order[whole], shared[whole] < n
        heads = places[opens]
        hashed = [zlib.crc32(words[i]) for i in ids[heads]] if n == 1 else [zlib.crc32(b" ".join([words[i] for i in ids[p : p + n]])) for p in heads]
        yield places, (np.array(hashed, np.int64) % buckets)[np.cumsum(opens) - 1]


def bucket_counts(docs: DataFrame, longest: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bucket, n: how many n-grams of 1 to `longest` words of all texts fall into each bucket that has any; a sum per task goes out."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for part in slices(batches):
            for _, bucket in bucket_places(*word_ids(*flat(part.column("text"))), longest, buckets):
                counts += np.bincount(bucket, minlength=buckets)
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(counts[hit])], ["bucket", "n"])

    return texts(docs, id_col, text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of each bucket's smoothed shares in target and source, rounded down."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    ratio = [(float(t) + 1.0) * (s_all + buckets) / ((float(s) + 1.0) * (t_all + buckets)) for s, t in zip(source, target)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """A thousand times a Gumbel draw that the seed and the id decide, rounded down; a missing id reads as nothing."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _dense(counts: DataFrame, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():  # a row for each bucket at most
        out[r.bucket] = r.n
    return out


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text", cell_rows: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_features, weight, score, rank.

    Features are all runs of 1 to `longest` words of whole texts, repeats counted, hashed into buckets. weight is the sum of
    the gains of a document's features (gains(), of target against docs), score adds noise(), so that the highest scores are
    a draw without replacement with probabilities by weight. Of the N documents with least_words words or more, the
    floor(percent * N / 100) with the highest scores get their rank, the smaller id first among equals and a missing id last;
    the others' is null. Null, empty and wordless texts have no features, weight 0, and are never drawn unless least_words is 0.
    Repeated rows are documents of their own with equal scores. Two passes over the texts, neither of which shuffles them;
    texts are cut into slices of 2 MB, a longer one is a slice of its own. Only the id and the text are read, so other
    columns may have any names. The ranks are numbered in cells of scores, at most 2 ** 16, so no task orders all rows.
    """
    spark = docs.sparkSession
    gain = gains(_dense(bucket_counts(docs, longest, buckets, id_col, text_col), buckets), _dense(bucket_counts(target, longest, buckets, target_id, target_text), buckets))

    def run(batches):
        for part in slices(batches):
            ids, words, edge = word_ids(*flat(part.column("text")))
            total, n = np.zeros(len(ids) + 1, np.int64), np.zeros(len(ids) + 1, np.int64)
            for places, bucket in bucket_places(ids, words, edge, longest, buckets):
                total[places + 1] += gain[bucket]
                n[places + 1] += 1
            sums = [np.diff(np.cumsum(x)[edge]) for x in (n, total)]
            key = part.column("doc_id").to_pylist()
            score = sums[1] + np.array([noise(i, seed) for i in key], np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (np.diff(edge), *sums, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    scored = save(texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long"), "scored")
    able = F.col("n_words") >= least_words
    down = -F.col("score").cast("double")
    cells = with_cell(scored.where(able), down, cell_bounds(scored.where(able).select(down.alias("v")), cell_rows))
    starts, n = [], 0
    for r in sorted(cells.groupBy("cell").count().collect()):  # a row for each cell
        starts.append((r.cell, n))
        n += r["count"]
    drawn = percent * n // 100
    order = Window.partitionBy("cell").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight")
    place = F.col("start") + F.row_number().over(order)
    ranked = cells.join(F.broadcast(spark.createDataFrame(starts, "cell int, start long")), "cell").withColumn("rank", F.when(place <= drawn, place).cast("long"))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")).select(*columns))
