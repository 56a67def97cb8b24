"""Exact dedup: a log-structured merge index of content digests, in DataFrame operations only.

The table arrives in BATCHES batches. Memtables, the partitions of a batch as they are scanned, are flushed as runs of (digest,
identifier, length) sorted by digest, without a shuffle. FANOUT runs of a level are compacted into one of the next, which keeps
the smallest identifier of each digest and the number of its copies. Each run has a filter, a bit map of its digests' hashes,
made when it is first asked. A look-up asks each run's filter first and joins only the digests that may be in it; so does the
search for repeats, where a compacted run gives out only what another run's filter lets pass, and what it has merged itself.
Hits receive byte verification: their normalised texts are compared with the one that stays. All copies of a hot text are
compared in parts, each beside its own copy of the text that stays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, BitMap, bit_map, narrow, parted, probed, save, texts

FANOUT = 4
#: A compaction's worth of batches and one more, which meets the compacted run as newer rows meet older ones.
BATCHES = FANOUT + 1
#: So many copies of one text, or a share of 1 / MOST_PARTS of all rows if that is more, are compared in one task. So there are
#: at most MOST_PARTS texts with several parts; these are broadcast, some 8 MB.
PART, MOST_PARTS = 2048, 100_000


def normalised(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.translate(text, SPACES, "")


class Run:
    """A run of the index: entries (digest, best, n), saved, each partition sorted by digest. merged: a digest has one entry."""

    def __init__(self, entries: DataFrame, merged: bool):
        self.entries, self.merged = entries, merged

    @cached_property
    def filter(self) -> BitMap | None:
        """The filter of the run's digests, see common.bit_map()."""
        bits = bit_map(self.entries.select("digest"), "digest")
        return bits and BitMap(bits.bits, save(bits.pieces, "filter"))


class DigestIndex:
    """levels[0] has the runs of flushed batches, levels[i + 1] those that compactions of level i have made."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[Run]] = [[]]

    def _run(self, entries: DataFrame, name: str, merged: bool) -> Run:
        """Partitions are sorted where they are; their files have the least and greatest digest of each page."""
        return Run(save(entries.sortWithinPartitions("digest"), name), merged)

    def flush(self, rows: DataFrame) -> DigestIndex:
        """rows: digest, doc_id, n_chars. A batch's memtables become a run; full levels are compacted."""
        best = F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id"))
        self.levels[0].append(self._run(rows.select("digest", best.alias("best"), F.lit(1).cast("long").alias("n")), "run", False))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1
        return self

    def compact(self, level: int = 0) -> DigestIndex:
        """Merges the runs of a level into one of the next; copies within a task are merged before anything is shuffled."""
        if level + 1 == len(self.levels):
            self.levels.append([])
        merged = _union([r.entries for r in self.levels[level]]).groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        self.levels[level + 1].append(self._run(merged, "compacted", True))
        self.levels[level] = []
        return self

    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def lookup(self, digests: DataFrame) -> DataFrame:
        """digests: saved rows with a digest. digest, best, n of those that the index has, over all its runs."""
        wanted = digests.select("digest")
        found = []
        for run in self.runs():
            asked = probed(wanted, run.filter, "digest")[0].distinct()
            found.append(run.entries.join(asked, "digest", "left_semi"))
        return _union(found).groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"))

    def repeated(self) -> DataFrame:
        """digest, best, n of the digests with more than one copy. Only entries that may be in another run, by its filter, and
        those of runs that are not merged are shuffled."""
        runs, met, alone = self.runs(), [], []
        for run in runs:
            rest = run.entries
            if run.merged:
                for other in runs:
                    if other is not run:
                        maybe, rest = probed(rest, other.filter, "digest")
                        met.append(maybe)
            (alone if run.merged else met).append(rest)
        if met:
            alone.append(_union(met).groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n")))
        return _union(alone).where("n > 1")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Equal are texts with the same bytes after ASCII white space is deleted; null counts as empty. Of equal texts the row with
    the most code points in its original text stays, then the smallest id; a null id sorts first. Rows repeated with the same
    id and text are one group, and each of them is kept if their id is. Other columns are ignored. digest: the index's key of
    a normalised text, SHA-256 if none is given. If byte verification finds two texts under one digest, the index is built
    again with the normalised bytes themselves as its key, which is right by construction. Texts of any length are compared
    whole; only those that have copies are shuffled.
    """
    rows = texts(docs, id_col, text_col).withColumn("norm", normalised(F.col("text")))
    sha = F.sha2(F.col("norm").cast("binary"), 256)
    key = sha if digest is None else digest(F.col("norm"))
    # Sorted by batch within partitions, so that reading a batch skips the pages of the others.
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)).cast("int").alias("batch")
    prints = rows.select("doc_id", F.char_length("text").alias("n_chars"), key.alias("digest"), *([sha.alias("text_sha256")] if digest else []), batch)
    prints = save(prints.sortWithinPartitions("batch"), "digests")
    index = DigestIndex()
    for nth in range(BATCHES):
        index.flush(prints.where(F.col("batch") == nth).select("digest", "doc_id", "n_chars"))
    repeated = save(index.repeated().select("digest", F.col("best.doc_id").alias("keep_id"), "best.shorter", "n"), "repeated")
    # A group of n copies is dealt into parts, by a hash of the row; each part has the group's entry for itself.
    part = max(PART, prints.count() // MOST_PARTS)
    parts = F.ceil(F.col("n") / part)
    split = repeated.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    several = F.broadcast(repeated.where(parts > 1).select("digest", parts.alias("parts")))

    def with_part(table: DataFrame) -> DataFrame:
        return table.join(several, "digest", "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "n_chars"), F.coalesce("parts", F.lit(1)))).drop("parts")

    stays_here = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == -F.col("shorter"))
    hits = with_part(narrow(rows.select("doc_id", F.char_length("text").alias("n_chars"), "norm", key.alias("digest")), repeated, "digest"))
    hits = save(hits, "hits")
    # Only the row that stays meets its group's entry: copies of a hot text are dealt by their ids.
    own = (F.col("h.digest") == F.col("r.digest")) & F.col("h.doc_id").eqNullSafe(F.col("r.keep_id")) & (F.col("h.n_chars") == -F.col("r.shorter"))
    stay = hits.alias("h").join(repeated.alias("r"), own).groupBy(F.col("r.digest").alias("digest")).agg(F.min("h.norm").alias("stay"))
    stays = split.select("digest", "part").join(stay, "digest")
    if not hits.join(stays, ["digest", "part"]).where("norm <> stay").isEmpty():
        return exact_dedup(docs, id_col, text_col, lambda c: c)
    maybe, never = parted(prints, repeated, "digest")
    out = with_part(maybe).join(split, ["digest", "part"], "left").unionByName(never.select("*", F.lit(None).cast("long").alias("part")), allowMissingColumns=True)
    alone = F.col("n").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (alone | stays_here).alias("kept"),
        F.col("text_sha256" if digest else "digest").alias("text_sha256"),
    )
