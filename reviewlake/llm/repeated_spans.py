"""Suffix-array dedup by a depth-limited radix sort: suffixes are ordered only through their first `length` bytes.

Suffixes are dealt into groups by one digit after another, and a group of one leaves the sort at once; what is still together
when all `length` bytes are read are exactly the repeated windows. Digits are hashes of byte strings and a pass is one shuffle:
  1. The digit of a window is its minimizer, the least hash of the strings of SHARE bytes in it (the leftmost of equals), so
     that equal windows have equal digits while neighbouring windows share one row, a run. One row stands for about 70 suffixes.
  2. Runs that share their digit with a run elsewhere are read to their full extent. Where all runs of a digit are the same
     bytes, they are done. Otherwise windows go on in bands of STEP neighbours, with the bytes common to the band as digit.
  3. Bands still in company are done where the bytes of all windows together are the same; else each window is a row of its own.
Counting uses the least and the greatest occurrence of a digit, so a pass keeps two numbers for a digit, however frequent.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import narrow, parted, release, save, texts
from .kernels import EXACT, INVERSE, flat, powers, prefix_hash, signed, slices, span_hash

POSITION_BITS = 28
#: Texts are taken in stretches of so many windows; a run that a stretch cuts is two runs, which costs only work.
STRETCH = 1 << 26
_POSITION = np.uint64((1 << POSITION_BITS) - 1)
BANDS = 4


def minimizer_runs(data: np.ndarray, at: np.ndarray, length: int, share: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, first, last, anchor (positions in data) of all runs, and the running hash: the windows that start at
    first..last have the string of `share` bytes at anchor as their minimizer."""
    h = prefix_hash(data, EXACT)
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none, h
    grams = np.arange(len(data) - share + 1)
    least = (span_hash(h, grams, grams + share) & ~_POSITION) | grams.astype(np.uint64)
    width, done = length - share + 1, 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < width:
        least = np.minimum(least[: n + 0], least[width - done : width - done + n])
    anchor = (least[:n] & _POSITION).astype(np.int64)
    doc = np.searchsorted(at, np.arange(n), "right") - 1
    valid = np.arange(n) + length <= at[doc + 1]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(valid & new)
    stop = np.ones(n, bool)
    stop[:-1] = new[1:] | ~valid[1:]
    last = np.flatnonzero(valid & stop)
    return doc[first], first, last, anchor[first], h


def _runs(rows: DataFrame, length: int, share: int) -> DataFrame:
    """rows: cid, text. A row per run: cid, first, last, anchor (byte offsets in the text), digit, extent (hashes)."""

    def run(batches):
        for part in slices(batches, limit=1 << 20):
            data, at = flat(part.column("text"))
            for begin in range(0, max(1, len(data)), STRETCH):
                end = min(len(data), begin + STRETCH + length - 1)
                doc, first, last, anchor, h = minimizer_runs(data[begin:end], np.clip(at, begin, end) - begin, length, share)
                cid = np.asarray(part.column("cid"))[doc]
                from_ = at[doc] - begin
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cid), pa.array((first - from_).astype(np.int32)), pa.array((last - from_).astype(np.int32)), pa.array((anchor - from_).astype(np.int32)),
                     pa.array(signed(span_hash(h, anchor, anchor + share))), pa.array(signed(span_hash(h, first, last + length)))],
                    ["cid", "first", "last", "anchor", "digit", "extent"],
                )

    return rows.mapInArrow(run, "cid long, first int, last int, anchor int, digit long, extent long")


def _inside(rows: DataFrame, kind: str, length: int, share: int) -> DataFrame:
    """rows: cid, text and lists of longs. kind "bands": a row per band of the runs; "windows": a row per window of the bands."""
    step = (length - share + 1) // BANDS

    def bands(h, size, x):
        digit, anchor, first, last = x
        j = np.arange(BANDS)[None, :]
        a, s, e = anchor[:, None], first[:, None], last[:, None]
        top = a - step * j  # the band's last window
        low, high = np.maximum(s, top - step + 1), np.minimum(e, top)
        r, j = np.nonzero(low <= high)
        low, high, top = low[r, j], high[r, j], top[r, j]
        inner = signed(span_hash(h, top, top - step + 1 + length))
        begin, end = top - step + 1, top + length
        whole = (begin >= 0) & (end <= size)
        outer = signed(span_hash(h, np.maximum(begin, 0), np.minimum(end, size)))
        return [digit[r], j.astype(np.int64), inner, pa.array(outer, mask=~whole), anchor[r], low, high]

    def windows(h, size, x):
        _, low, high = x
        n = high - low + 1
        i = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return [signed(span_hash(h, i, i + length)), i]

    make, names = (bands, ["digit", "band", "inner", "outer", "anchor", "low", "high"]) if kind == "bands" else (windows, ["whole", "low"])
    width = 4 if kind == "bands" else 3

    def run(batches):
        for part in slices(batches, limit=1 << 20):
            data, at = flat(part.column("text"))
            h = prefix_hash(data, EXACT)
            lists = part.column("items")
            edges, values = np.asarray(lists.offsets) - lists.offsets[0].as_py(), np.asarray(lists.flatten())
            for k in range(part.num_rows):
                x = values[edges[k] : edges[k + 1]].reshape(-1, width).T
                # Hashes of one text: its own running hash, so that positions count from its start.
                own = (h[at[k] : at[k + 1] + 1] - h[at[k]]) * powers(INVERSE, len(h))[at[k]]
                columns = make(own, at[k + 1] - at[k], x)
                cid = np.full(len(columns[0]), part.column("cid")[k].as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cid), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns)], ["cid", *names])

    return rows.mapInArrow(run, "cid long, " + ", ".join(f"{n} long" for n in names))


def _company(rows: DataFrame, keys: list[str], place: str, more: str | None = None) -> DataFrame:
    """The keys that occur at two places at least; with `more`, also whether all rows of a key have the same value of it."""
    seen = F.xxhash64("cid", place)
    aggs = [F.min(seen).alias("_a"), F.max(seen).alias("_b")]
    if more:
        aggs += [F.min(more).alias("_c"), F.max(more).alias("_d"), F.count("*").alias("_n"), F.count(more).alias("_m")]
    got = rows.groupBy(*keys).agg(*aggs).where("_a <> _b")
    return got.select(*keys, *([(F.coalesce(F.col("_c") == F.col("_d"), F.lit(False)) & (F.col("_n") == F.col("_m"))).alias("same")] if more else []))


def repeated_windows(rows: DataFrame, length: int, share: int) -> DataFrame:
    """rows: cid, text, each cid once or with the same text each time. cid, low, high: the starts low..high of windows that occur elsewhere too."""
    runs = _runs(rows, length, share)
    shared = save(runs.join(_company(runs, ["digit"], "first", "extent"), "digit").select("cid", "digit", "anchor", "first", "last", "same"), "runs")
    long = lambda *names: F.array(*[F.col(n).cast("long") for n in names])
    listed = shared.where("not same").groupBy("cid").agg(F.flatten(F.collect_set(long("digit", "anchor", "first", "last"))).alias("items"))
    listed = save(listed, "listed")
    bands = _inside(narrow(rows, listed, "cid").join(listed, "cid"), "bands", length, share)
    keys = ["digit", "band", "inner"]
    alive = save(bands.join(_company(bands, keys, "anchor", "outer"), keys), "bands")
    unlike = alive.where("not same").groupBy("cid").agg(F.flatten(F.collect_set(long("digit", "low", "high"))).alias("items"))
    unlike = save(unlike, "unlike")
    release(listed)
    windows = _inside(narrow(rows, unlike, "cid").join(unlike, "cid"), "windows", length, share)
    # Rows are many and small here, so they are shuffled once: a window's rows meet, and stay if they show two places.
    seen, places = F.xxhash64("cid", "low"), Window.partitionBy("whole")
    single = windows.select("cid", "low", (F.min(seen).over(places) != F.max(seen).over(places)).alias("again")).where("again")
    return (
        shared.where("same").select("cid", F.col("first").cast("long").alias("low"), F.col("last").cast("long").alias("high"))
        .union(alive.where("same").select("cid", "low", "high"))
        .union(single.select("cid", "low", F.col("low").alias("high")))
    )


def _contents(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with cid, a number of the text, and a saved table cid, copies, least (doc_id).

    cid is a hash of the text. Where two texts share one, which a second hash tells, they get another, of more of the text's hash:
    there are n ** 2 / 2 ** 65 such pairs among n texts, so few that they are broadcast (some 30,000 among 10 ** 12).
    """
    other = F.xxhash64(F.lit(1), "text")
    rows = rows.withColumn("cid", F.xxhash64("text"))
    aggs = [F.count("*").alias("copies"), F.min("doc_id").alias("least"), (F.min(other) != F.max(other)).alias("clash")]
    contents = save(rows.groupBy("cid").agg(*aggs), "contents")
    clash = contents.where("clash").select("cid", "clash")
    if not clash.isEmpty():
        rows = rows.join(F.broadcast(clash), "cid", "left").withColumn("cid", F.when(F.col("clash"), F.xxhash64(F.md5(F.col("text").cast("binary")), "cid")).otherwise(F.col("cid"))).select("doc_id", "text", "cid")
        contents = save(rows.groupBy("cid").agg(*aggs), "contents")
    return rows, contents.drop("clash")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, share: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256.

    Texts are UTF-8 bytes, null texts empty. Each byte is removed that lies in a string of `length` bytes which also starts at
    another place, in any document or the same one; overlapping places count, and all strings are judged on the input. kept:
    the remaining bytes, joined (binary: a cut may fall within a character). n_spans: maximal removed runs. Of equal texts,
    all are removed whole if they have `length` bytes. Texts shorter than that stay as they are. Texts of any length are read
    whole; a worker needs some twenty times the bytes of its longest text. Runs and bands count as equal where two hashes of 64
    bits agree, single windows, those of the last pass, where one does: a few of n such windows, n ** 2 / 2 ** 65, may be taken
    for repeats. Other columns are left out, and rows repeated count as copies.
    """
    share = share or length // 3 - 1 + (length - (length // 3 - 1) + 1) % BANDS  # so that bands are equal
    step = (length - share + 1) // BANDS
    if step < 1 or step * BANDS != length - share + 1:
        raise ValueError(f"length - share + 1 must be a multiple of {BANDS}")
    rows, contents = _contents(texts(docs, id_col, text_col))
    long_rows = rows.where(F.octet_length("text") >= length)
    # A text stands for its copies: the digits of one are those of all.
    # Copies that come along do no harm, as a cid's places count once.
    some = narrow(long_rows.where("doc_id is not null"), contents.select(F.col("least").alias("doc_id"))).union(long_rows.where("doc_id is null")).select("cid", "text")
    found = repeated_windows(some, length, share)
    ranges = F.flatten(F.collect_set(F.when(F.col("low") < F.col("high"), F.array(F.col("low").cast("int"), F.col("high").cast("int")))))
    spans = found.groupBy("cid").agg(ranges.alias("spans"), F.collect_set(F.when(F.col("low") == F.col("high"), F.col("low").cast("int"))).alias("singles"))
    spans = save(spans, "spans")

    def cut(batches):
        for part in slices(batches):
            out = [[], [], [], []]
            ranges, singles = part.column("spans"), part.column("singles")
            for k in range(part.num_rows):
                raw = np.frombuffer(part.column("text")[k].as_py().encode(), np.uint8)
                x = np.concatenate([np.asarray(ranges[k].values).reshape(-1, 2), np.repeat(np.asarray(singles[k].values)[:, None], 2, 1)]).astype(np.int64)
                cover = np.zeros(len(raw) + 1, np.int64)
                np.add.at(cover, x[:, 0], 1)
                np.add.at(cover, x[:, 1] + length, -1)
                gone = np.cumsum(cover)[:-1] > 0
                kept = raw[~gone].tobytes()
                for o, v in zip(out, (int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), kept, hashlib.sha256(kept).hexdigest())):
                    o.append(v)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(flat(part.column("text"))[1])), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    size = F.octet_length("text").cast("long")

    def whole_or_not(table: DataFrame, whole: Column) -> DataFrame:
        kept = F.when(whole, F.lit("")).otherwise(F.col("text")).cast("binary")
        n_removed, n_spans = F.when(whole, size).otherwise(F.lit(0)), F.when(whole, F.lit(1)).otherwise(F.lit(0))
        return table.select("doc_id", size.alias("n_bytes"), n_removed.cast("long").alias("n_removed"), n_spans.cast("long").alias("n_spans"), kept.alias("kept"), F.sha2(kept, 256).alias("kept_sha256"))

    touched = contents.where("copies > 1").select("cid").union(spans.select("cid"))
    maybe, never = parted(rows, touched, "cid")
    joined = maybe.join(contents.select("cid", "copies"), "cid").join(spans, "cid", "left")
    whole = (F.col("copies") > 1) & (size >= length)
    plain = whole_or_not(never, F.lit(False)).unionByName(whole_or_not(joined.where(whole | F.col("spans").isNull()), whole))
    parts = joined.where(~whole & F.col("spans").isNotNull()).select("doc_id", "text", "spans", "singles")
    return plain.unionByName(parts.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"))
