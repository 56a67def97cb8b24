"""Document fingerprints from prefix polynomial hashes.

A text's code points c give, for two primes p, the prefix array H[0] = 0, H[i + 1] = (H[i] * B + c[i] + 1) mod p. Any span's hash is
H[j] - H[i] * B ** (j - i), so two spans are compared in constant time, a longest common extension is found by binary search,
and the hashes of a text that is put together from spans of others follow from theirs. A fingerprint keeps a few of these hashes:
of prefixes and suffixes whose lengths lie on a grid, and the smallest of all windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cell_bounds, texts, with_cell
from .kernels import mix, slices

PRIMES = (2147483647, 2147483629)
BASES = (1469598103, 1099511631)
#: Prefix arrays are made in stretches of so many code points; only the arrays themselves grow with a text, by 8 bytes a code point.
STRETCH = 1 << 16
#: Code points of a window, prefix and suffix lengths at most, and smallest window hashes of a fingerprint.
WINDOW, GRID, SMALLEST = 16, 16, 32


def _tables(p: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -(i + 1) modulo p, for a stretch."""
    inverse = pow(base, -1, p)
    power, back = np.ones(STRETCH + 1, np.int64), np.full(STRETCH, inverse, np.int64)
    n = 1
    while n <= STRETCH:  # doubling: the second half is the first, times one power
        m = min(n, STRETCH + 1 - n)
        power[n : n + m] = power[:m] * pow(base, n, p) % p
        m = min(n, STRETCH - n)
        if m > 0:
            back[n : n + m] = back[:m] * pow(inverse, n, p) % p
        n *= 2
    return power, back


_TABLES = [_tables(p, b) for p, b in zip(PRIMES, BASES)]


def points_of(text: str | bytes) -> np.ndarray:
    """The code points; bytes are UTF-8, in which broken sequences count as U+FFFD."""
    text = text.decode("utf-8", "replace") if isinstance(text, bytes) else text
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Prefixes:
    """The prefix arrays of one text: h[k][i] is the hash of its first i code points modulo PRIMES[k]."""

    def __init__(self, points: np.ndarray):
        n = self.n = len(points)
        self.h = np.zeros((2, n + 1), np.uint32)
        for k, p in enumerate(PRIMES):
            power, back = _TABLES[k]
            carry = 0
            for i in range(0, n, STRETCH):
                c = points[i : i + STRETCH].astype(np.int64) + 1
                m = len(c)
                here = power[1 : m + 1] * (np.cumsum(c * back[:m] % p) % p) % p
                if i:
                    here = (here + carry * power[1 : m + 1]) % p
                self.h[k, i + 1 : i + m + 1] = here
                carry = int(here[-1])

    def at(self, i: int) -> tuple[int, int]:
        """The hashes of the first i code points."""
        return int(self.h[0, i]), int(self.h[1, i])

    def span(self, i: int, j: int) -> tuple[int, int]:
        """The hashes of the code points from i up to j."""
        return tuple((int(self.h[k, j]) - int(self.h[k, i]) * pow(BASES[k], j - i, p)) % p for k, p in enumerate(PRIMES))

    def windows(self, size: int = WINDOW) -> np.ndarray:
        """A 32-bit hash of each window of `size` code points; of the whole text, if it is shorter; none of an empty one."""
        size = min(size, self.n)
        out = np.zeros(self.n - size + 1 if self.n else 0, np.uint32)
        for i in range(0, len(out), STRETCH):
            j = min(i + STRETCH, len(out))
            a, b = ((self.h[k, i + size : j + size].astype(np.int64) - self.h[k, i:j] * np.int64(pow(BASES[k], size, p))) % p for k, p in enumerate(PRIMES))
            out[i:j] = mix((a << 31 | b).view(np.uint64)) >> np.uint64(32)
        return out


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """How many code points from a's i and b's j on are equal: the longest equal spans, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a.span(i, i + mid) == b.span(j, j + mid) else (low, mid - 1)
    return low


class Joined:
    """The prefix hashes of a text that is the first `keep` code points of one text and the first `more` of another."""

    def __init__(self, first: Prefixes, keep: int, second: Prefixes, more: int):
        self.first, self.keep, self.second, self.n = first, keep, second, keep + more

    def at(self, i: int) -> tuple[int, int]:
        if i <= self.keep:
            return self.first.at(i)
        head, tail = self.first.at(self.keep), self.second.at(i - self.keep)
        return tuple((head[k] * pow(BASES[k], i - self.keep, p) + tail[k]) % p for k, p in enumerate(PRIMES))


def _step(n: int) -> int:
    """The smallest power of two that is at least n / GRID: grids of different texts are parts of one another."""
    step = 1
    while n > step * GRID:
        step *= 2
    return step


def _smallest(parts: list[np.ndarray]) -> np.ndarray:
    """The SMALLEST smallest distinct values of all parts, in order; all, where there are fewer."""
    n = sum(len(x) for x in parts)
    share = 4 * SMALLEST / max(n, 1)
    while True:
        below = np.uint32(min(share, 1.0) * 0xFFFFFFFF)
        found = np.unique(np.concatenate([x[x <= below] for x in parts] or [np.zeros(0, np.uint32)]))
        if len(found) >= SMALLEST or share >= 1:
            return found[:SMALLEST]
        share *= 8


def _number(pair: tuple[int, int]) -> int:
    return pair[0] << 31 | pair[1]


def _pack(text: Prefixes | Joined, smallest: np.ndarray) -> str:
    """The fingerprint: length, hash of all, then 8 hex digits for each prefix and suffix of the grid and each smallest hash."""
    n, step = text.n, _step(text.n)
    whole, grid = text.at(n), range(step, n + 1, step)
    prefix = [_number(text.at(i)) for i in grid]
    suffix = []
    for i in grid:
        rest = text.at(n - i)
        suffix.append(_number(tuple((whole[k] - rest[k] * pow(BASES[k], i, p)) % p for k, p in enumerate(PRIMES))))
    short = mix(np.array(prefix + suffix, np.uint64)) >> np.uint64(32)
    words = np.concatenate([short.astype(">u4"), smallest.astype(">u4")])
    return f"{n:x}.{_number(whole):016x}.{words.tobytes().hex()}"


class Parts(NamedTuple):
    """What a fingerprint holds."""

    n: int
    whole: str
    prefix: list[str]
    suffix: list[str]
    smallest: list[str]


def unpack(fingerprint: str) -> Parts:
    n, whole, rest = fingerprint.split(".")
    words = [rest[i : i + 8] for i in range(0, len(rest), 8)]
    size = int(n, 16)
    g = size // _step(size)
    return Parts(size, whole, words[:g], words[g : 2 * g], words[2 * g :])


def _equal_to(a: list[str], b: list[str], every_a: int, every_b: int) -> int:
    """How many places of the coarser grid two texts are equal up to: equal hashes end once, so by binary search."""
    low, high = 0, min(len(a) // every_a, len(b) // every_b)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[mid * every_a - 1] == b[mid * every_b - 1] else (low, mid - 1)
    return low


def likeness(one: str, other: str) -> float:
    """How alike two fingerprints are: 1 for equal texts, 0 where only one is empty.

    Else the greater of two shares: of code points in the common prefix and suffix, as far as the grid tells, to the longer
    text's; and of windows that both have among all their windows, estimated from the smallest.
    """
    a, b = unpack(one), unpack(other)
    if (a.n, a.whole) == (b.n, b.whole):
        return 1.0
    if not a.n or not b.n:
        return 0.0
    sa, sb = _step(a.n), _step(b.n)
    step = max(sa, sb)
    same = step * (_equal_to(a.prefix, b.prefix, step // sa, step // sb) + _equal_to(a.suffix, b.suffix, step // sa, step // sb))
    union = sorted({*a.smallest, *b.smallest})[:SMALLEST]
    both = {*a.smallest} & {*b.smallest}
    return max(min(same, a.n, b.n) / max(a.n, b.n), sum(x in both for x in union) / len(union))


def fingerprint(text: str | bytes) -> str:
    """The fingerprint of one text; equal texts have equal fingerprints."""
    h = Prefixes(points_of(text))
    return _pack(h, _smallest([h.windows()]))


class _Doc:
    """A document with its prefix arrays, window hashes and fingerprint."""

    def __init__(self, doc_id: int | None, text: bytes):
        self.id, self.points = doc_id, points_of(text)
        self.h = Prefixes(self.points)
        self.w = self.h.windows()
        self.fingerprint = _pack(self.h, _smallest([self.w]))

    def edited(self, after: _Doc) -> tuple[str, str]:
        """sha256 and fingerprint of this text, the last half replaced by as many first code points of the next one.

        All but the windows across the seam have their hashes already.
        """
        half = self.h.n // 2
        keep, more = self.h.n - half, min(half, after.h.n)
        parts = [self.points[:keep], after.points[:more]]
        sha = hashlib.sha256(b"".join(x.tobytes() for x in parts).decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"))
        if keep + more <= WINDOW:
            windows = [Prefixes(np.concatenate(parts)).windows()]
        else:
            seam = np.concatenate([parts[0][-(WINDOW - 1) :], parts[1][: WINDOW - 1]])
            windows = [self.w[: max(0, keep - WINDOW + 1)], after.w[: max(0, more - WINDOW + 1)]]
            if len(seam) >= WINDOW:
                windows.append(Prefixes(seam).windows())
        return sha.hexdigest(), _pack(Joined(self.h, keep, after.h, more), _smallest(windows))


FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by cell and in order, the row that follows a cell last: each but that is compared with the one behind it."""
    before: _Doc | None = None
    cell, closed = None, True
    for part in slices(batches, limit=1 << 19):
        rows = []
        ids, tails, cells = (part.column(c).to_pylist() for c in ("doc_id", "tail", "cell"))
        for i, text in enumerate(part.column("text")):
            if cells[i] == cell and closed:  # further copies of the following row
                continue
            doc = _Doc(ids[i], text.as_buffer().to_pybytes())
            if cells[i] == cell:
                sha, edited = before.edited(doc)
                rows.append((before.id, before.h.n, sha, before.fingerprint, edited, likeness(before.fingerprint, edited), likeness(before.fingerprint, doc.fingerprint)))
            cell, closed, before = cells[i], tails[i], doc
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [c.split()[0] for c in FINGERPRINTS.split(", ")])


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = 1024) -> DataFrame:
    """One row per row of docs: FINGERPRINTS, from its whole text, its edited text and the next document.

    Documents are in descending order of the id, null ids last, ties by the text; after the last comes the first (the only one
    follows itself). The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of the
    next one. Null texts count as empty ones, of length 0, whose edited text is empty; repeated rows follow each other. Only the
    id and the text are read, so other columns may have any names. Texts of any length are used whole; a task holds two
    documents with 12 bytes a code point.

    Ids are dealt into cells of about cell_rows documents, 2 ** 16 cells at most, so texts are shuffled once and no task orders all;
    the first document of each cell is sent to the cell before, too. Rows that share one id, or have none, stay in one cell, which
    is streamed.
    """
    bounds = cell_bounds(docs.select((-F.col(id_col).cast("double")).alias("v")), cell_rows)
    rows = with_cell(texts(docs, id_col, text_col), -F.col("doc_id").cast("double"), bounds)
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("place", F.struct(F.col("doc_id").isNull().alias("no_id"), (-F.col("doc_id").cast("decimal(20,0)")).alias("down"), "tie"))
    firsts = rows.groupBy("cell").agg(F.min("place").alias("place")).collect()  # a row for each cell, see above
    order = sorted(r.cell for r in firsts)
    before = {c: order[i - 1] for i, c in enumerate(order)}
    first = docs.sparkSession.createDataFrame([(before[r.cell], r.place.no_id, r.place.down, r.place.tie, r.cell) for r in firsts], "earlier int, no_id boolean, down decimal(20,0), first_tie long, cell int")
    joined = rows.join(F.broadcast(first), "cell")
    is_first = (F.col("place.no_id") == F.col("no_id")) & F.col("place.down").eqNullSafe(F.col("down")) & (F.col("tie") == F.col("first_tie"))
    own, ahead = F.struct("cell", F.lit(False).alias("tail")), F.struct(F.col("earlier").alias("cell"), F.lit(True).alias("tail"))
    dealt = joined.withColumn("to", F.explode(F.when(is_first, F.array(own, ahead)).otherwise(F.array(own)))).select("to.cell", "to.tail", "doc_id", "text", "tie")
    dealt = dealt.repartition("cell").sortWithinPartitions("cell", "tail", F.col("doc_id").desc_nulls_last(), "tie", "text")
    return dealt.select("cell", "tail", "doc_id", "text").mapInArrow(_compare, FINGERPRINTS)


def common_extensions(pairs: DataFrame) -> DataFrame:
    """pairs: left_text, left_at, right_text, right_at. Adds extension: how many code points are equal from the two places on.

    Null texts count as empty; places beyond a text's end, negative or null ones give 0. Works in Arrow batches, where the rows lie.
    """

    @F.pandas_udf("long")
    def extension(left: pd.Series, i: pd.Series, right: pd.Series, j: pd.Series) -> pd.Series:
        out = []
        for x, p, y, q in zip(left, i, right, j):
            a, b = Prefixes(points_of(x)), Prefixes(points_of(y))
            out.append(common_extension(a, int(p), b, int(q)) if 0 <= p <= a.n and 0 <= q <= b.n else 0)
        return pd.Series(out, dtype="int64")

    text, place = (lambda c: F.coalesce(F.col(c), F.lit(""))), (lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-1)))
    return pairs.withColumn("extension", extension(text("left_text"), place("left_at"), text("right_text"), place("right_at")))
