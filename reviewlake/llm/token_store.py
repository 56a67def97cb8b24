"""Token-ID output: documents as separately compressed zstandard frames under one shared dictionary, with an offset index.

The format, a folder:
  dictionary/  one row: dict_id (long, the dictionary's id in its zstandard header), sha256 (hex), dictionary (binary).
  blocks/      Parquet rows in ascending document order within and across shards:
               shard, block (ints: the order), dict_sha256 (string: which dictionary), first_id, last_id (longs),
               doc_ids (array of long), offsets (array of long: where each frame of `frames` starts, and the end),
               n_tokens (array of int), frames (binary: one zstandard frame per document).
A frame holds the document's ids as little-endian unsigned 32-bit integers. To read one document, filter blocks on first_id and
last_id (Parquet's statistics skip the rest), slice its frame by the offsets and decompress it alone.
Spark's own writer commits the files, so they can be in any store that Spark writes, and a lost task leaves nothing behind.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, scratch, texts
from .kernels import flat, slices, word_bounds

END_ID = 2
#: Documents of more characters are not among those that the dictionary is trained on; all are encoded with it.
MOST_SAMPLED = 20_000
_memo: dict[str, WordCoder] = {}


class WordCoder:
    """Encodes texts word by word, each distinct word once.

    Right for tokenizers whose pre-tokenizer drops white space and whose normaliser treats words one by one, as
    word_bpe_49k.json: there a text's ids are its words' ids, joined. Words are told apart by their exact bytes, those of ASCII
    only by these in lower case, as the normaliser lower-cases them first or last with the same result. Texts that hold the text
    of an added token, in any case, are not treated so but given to the library whole.
    """

    def __init__(self, path: str, most: int = 1_500_000):
        from tokenizers import Tokenizer

        self.coder, self.most = Tokenizer.from_file(path), most
        self.added = sorted({t.content.encode().lower() for t in self.coder.get_added_tokens_decoder().values()} - {b""})
        self.forget()

    @classmethod
    def at(cls, path: str) -> WordCoder:
        """One for each Python worker, so what it knows serves later tasks too."""
        if path not in _memo:
            _memo[path] = cls(path)
        return _memo[path]

    def forget(self) -> None:
        """Known words: their numbers, where their ids start, and the ids; there is room for as many again."""
        self.number: dict[bytes, int] = {}
        self.start, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.uint32)

    def _learn(self, words: list[bytes]) -> None:
        got = [e.ids for e in self.coder.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        n, size = len(self.number), np.fromiter(map(len, got), np.int64, len(got))
        ends = self.start[n] + np.cumsum(size)
        if n + len(words) >= len(self.start):
            self.start = np.concatenate([self.start, np.zeros(n + len(words), np.int64)])
        if ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(ends[-1], np.uint32)])
        self.ids[self.start[n] : ends[-1]] = np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))
        self.start[n + 1 : n + 1 + len(words)] = ends
        self.number.update(zip(words, range(n, n + len(words))))

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and where each text's start; the last entry is the end."""
        starts, ends, doc = word_bounds(data, at)
        size, wide = ends - starts, np.zeros(len(data) + 1, np.int32)
        np.cumsum(data >= 128, out=wide[1:])
        letters = ragged(data, starts, size)
        letters[((letters - np.uint8(65)) < 26) & np.repeat(wide[ends] == wide[starts], size)] += np.uint8(32)
        words = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(letters)]).dictionary_encode()
        distinct, nth = words.dictionary.to_pylist(), np.asarray(words.indices)
        if len(self.number) + len(distinct) > self.most:
            self.forget()
        get = self.number.get
        new = [w for w in distinct if get(w) is None]
        if new:
            self._learn(new)
        word = np.fromiter(map(self.number.__getitem__, distinct), np.int64, len(distinct))[nth] if distinct else np.zeros(0, np.int64)
        size = self.start[word + 1] - self.start[word]
        total = np.concatenate([[0], np.cumsum(size)])
        return ragged(self.ids, self.start[word], size), total[np.searchsorted(doc, np.arange(len(at)))]

    def holding_added(self, data: np.ndarray, at: np.ndarray) -> list[int]:
        """The texts that hold the text of an added token, in any case of A-Z."""
        raw, found = data.tobytes().lower(), set()
        for token in self.added:
            k = raw.find(token)
            while k >= 0:
                found.add(int(np.searchsorted(at, k, "right")) - 1)
                k = raw.find(token, k + 1)
        return sorted(found)

    def encode_each(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Each text's ids. A token's text that two neighbouring texts make together only costs time."""
        ids, edge = self.encode(data, at)
        out = [ids[i:j] for i, j in zip(edge[:-1], edge[1:])]
        for k in self.holding_added(data, at):
            text = data[at[k] : at[k + 1]].tobytes().decode()
            out[k] = np.array(self.coder.encode(text, add_special_tokens=False).ids, np.uint32)
        return out


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[s : s + n] of each (s, n), joined."""
    ends = np.cumsum(sizes)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def encode_each(part: pa.RecordBatch, path: str, end_id: int) -> list[np.ndarray]:
    """Each text's ids with the end id."""
    end = np.array([end_id], np.uint32)
    return [np.concatenate([ids, end]).astype("<u4") for ids in WordCoder.at(path).encode_each(*flat(part.column("text")))]


def train_dictionary(rows: DataFrame, path: str, end_id: int, samples: int, size: int) -> bytes:
    """A dictionary of at most `size` bytes from whole documents: of those of at most MOST_SAMPLED characters the `samples` with
    the smallest hash of their id and text.

    zstandard's trainer takes a sample by its nature; it only moves the compression rate, never a result. A table too small
    to train on gets a dictionary of raw bytes, the sample's own.
    """
    some = rows.where(F.char_length("text") <= MOST_SAMPLED).orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(samples).select("doc_id", "text")
    arrays = [a.tobytes() for part in slices(some.toArrow().to_batches()) for a in encode_each(part, path, end_id)]
    try:
        return zstandard.train_dictionary(size, arrays, dict_id=zlib.crc32(b"".join(arrays)) % (2**31 - 32768) + 32768).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(arrays)[-size:]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, samples: int = 512, dict_bytes: int = 65_536, block_bytes: int = 1 << 20, level: int = 3) -> None:
    """Encodes every text and writes the format above to path; null texts count as empty and have just the end id.

    Documents are ordered by id, then by text, null ids first; rows repeated in both are all written. The table is dealt into
    ranges of that order, so a shard is a range and no task holds more than its own; a block closes at block_bytes of frames.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    dictionary = train_dictionary(rows, tokenizer, end_id, samples, dict_bytes)
    sha = hashlib.sha256(dictionary).hexdigest()
    shape = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    spark.createDataFrame([(shape.dict_id() if shape else 0, sha, bytearray(dictionary))], "dict_id long, sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    schema = "shard int, block int, dict_sha256 string, first_id long, last_id long, doc_ids array<long>, offsets array<long>, n_tokens array<int>, frames binary"
    arrow = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("dict_sha256", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("frames", pa.binary())])

    def run(batches):
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
        shard = block = 0
        ids, sizes, frames, held = [], [], [], 0

        def close():
            at = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            real = [i for i in ids if i is not None]
            row = [shard, block, sha, min(real, default=None), max(real, default=None), ids[:], at, sizes[:], b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, arrow)], schema=arrow)

        for part in slices(batches):
            shard = part.column("shard")[0].as_py()
            for i, a in zip(part.column("doc_id").to_pylist(), encode_each(part, tokenizer, end_id)):
                ids.append(i)
                sizes.append(len(a))
                frames.append(packer.compress(a.tobytes()))
                held += len(frames[-1])
                if held >= block_bytes or len(ids) >= 20_000:
                    yield close()
                    block, held = block + 1, 0
                    ids, sizes, frames = [], [], []
        if ids:
            yield close()

    tie = F.xxhash64("text").alias("tie")
    dealt = rows.select("doc_id", "text", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "text")
    dealt.select("doc_id", "text", F.spark_partition_id().alias("shard")).mapInArrow(run, schema).write.parquet(f"{path}/blocks")


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row["dictionary"])
    if hashlib.sha256(dictionary).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary does not match its hash")
    return dictionary


def read_tokens(spark: SparkSession, path: str, where: Column | None = None, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, shard, block, nth, ids: each document's ids, its frame decompressed alone. doc_ids: only these, by the index."""
    dictionary = read_dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    wanted = None if doc_ids is None else set(doc_ids)
    if wanted is not None:
        blocks = blocks.where(F.lit(False) if not wanted else (F.col("first_id") <= max(wanted)) & (F.col("last_id") >= min(wanted)))
    sha = hashlib.sha256(dictionary).hexdigest()

    def run(batches):
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for r in batch.to_pylist():
                if r["dict_sha256"] != sha:
                    raise ValueError("a block was written with another dictionary")
                keep = [k for k, i in enumerate(r["doc_ids"]) if wanted is None or i in wanted]
                for a in range(0, len(keep), 256):
                    some = keep[a : a + 256]
                    ids = [np.frombuffer(unpack.decompress(r["frames"][r["offsets"][k] : r["offsets"][k + 1]]), "<u4") for k in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["doc_ids"][k] for k in some], pa.int64()), pa.array([r["shard"]] * len(some), pa.int32()), pa.array([r["block"]] * len(some), pa.int32()), pa.array(some, pa.int32()),
                         pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int64)))],
                        ["doc_id", "shard", "block", "nth", "ids"],
                    )

    return blocks.mapInArrow(run, "doc_id long, shard int, block int, nth int, ids array<long>")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files: start counts the ids of all documents before it."""
    dictionary = read_dictionary(spark, path)

    def run(batches):
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for r in batch.to_pylist():
                raw = [unpack.decompress(r["frames"][i:j]) for i, j in zip(r["offsets"], r["offsets"][1:])]
                n = np.array([len(x) // 4 for x in raw], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array([r["shard"]] * len(n), pa.int32()), pa.array([r["block"]] * len(n), pa.int32()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(x) for x in raw], pa.int64())],
                    ["doc_id", "shard", "block", "within", "n_tokens", "ids_crc32"],
                )

    rows = spark.read.parquet(f"{path}/blocks").mapInArrow(run, "doc_id long, shard int, block int, within long, n_tokens long, ids_crc32 long")
    sizes = spark.read.parquet(f"{path}/blocks").select("shard", "block", F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)").alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    before = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.select("shard", "block", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("block_start"))
    starts = blocks.join(before, "shard")
    return rows.join(starts, ["shard", "block"]).select("doc_id", (F.col("shard_start") + F.col("block_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def write_and_digest(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes the documents' ids to a new folder of the shared one and reads their digests back."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer, **options)
    return token_digests(spark, path)
