"""Embedding whitening from an exact integer scatter.

Entries become integers; sums and cross-products of the shifted integers are added up without rounding, n * X'X - S S' is formed in
arbitrary precision, and only that is turned into floating point and decomposed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

#: Integers are cut into limbs of 21 bits: products of limbs over BLOCK rows stay below 2 ** 53, which doubles add up exactly.
LIMB, BLOCK, FOLD = 21, 1024, 256
#: Entries beyond this are set to it, with their sign, so that all of them are 64-bit integers.
MOST = 2.0**62
#: Partial sums of so many tasks are added in one.
FAN = 32
#: A direction with less than this share of the variance counts as having none.
FLAT = 1e-13


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as doubles l0, l1, ... with x = l0 + l1 * 2 ** LIMB + ...; all but the last are not negative."""
    out = []
    while x.size and (x.max() >= 1 << LIMB or x.min() < -(1 << LIMB)):
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


class Scatter:
    """n, the sums and the cross-products (upper triangle, by rows) of integer vectors, in arbitrary precision."""

    def __init__(self, d: int):
        self.d, self.n, self._waiting = d, 0, 0
        self.upper = np.triu_indices(d)
        self.sums, self.cross = np.zeros(d, object), np.zeros(len(self.upper[0]), object)
        self._part: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, x: np.ndarray) -> None:
        """Adds rows of 64-bit integers."""
        for i in range(0, len(x), BLOCK):
            limbs = _limbs(x[i : i + BLOCK])
            self.n += len(limbs[0])
            for a, left in enumerate(limbs):
                self._sums_at(a)[:] += left.sum(0).astype(np.int64)
                for b, right in enumerate(limbs):
                    self._cross_at(a + b)[:] += (left.T @ right).astype(np.int64)[self.upper]
            self._waiting += 1
            if self._waiting == FOLD:
                self._fold()

    def _at(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self._part.setdefault(k, (np.zeros(self.d, np.int64), np.zeros(len(self.cross), np.int64)))

    def _sums_at(self, k: int) -> np.ndarray:
        return self._at(k)[0]

    def _cross_at(self, k: int) -> np.ndarray:
        return self._at(k)[1]

    def _fold(self) -> None:
        for k, (sums, cross) in self._part.items():
            self.sums += sums.astype(object) << (LIMB * k)
            self.cross += cross.astype(object) << (LIMB * k)
        self._part, self._waiting = {}, 0

    def row(self) -> pa.RecordBatch:
        self._fold()
        parts = [[str(v) for v in x] for x in (self.sums, self.cross)]
        return pa.RecordBatch.from_arrays([pa.array([self.n], pa.int64()), *(pa.array([x], pa.list_(pa.string())) for x in parts)], ["n", "sums", "crosses"])

    def take(self, n: int, sums: list[str], crosses: list[str]) -> None:
        """Adds another task's row."""
        self.n += n
        self.sums += np.array([int(v) for v in sums], object)
        self.cross += np.array([int(v) for v in crosses], object)

    def numerator(self) -> np.ndarray:
        """n * X'X - S S', which is n ** 2 times the covariance and does not depend on a shift."""
        self._fold()
        out = np.zeros((self.d, self.d), object)
        out[self.upper] = self.n * self.cross - self.sums[self.upper[0]] * self.sums[self.upper[1]]
        out.T[self.upper] = out[self.upper]
        return out


def integers(batch: pa.RecordBatch, d: int, scale: float, add: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """In blocks: ids and floor(scale * c) + add of the vectors of length d whose entries are all there and finite."""
    for i in range(0, batch.num_rows, BLOCK):
        part = batch.slice(i, BLOCK)
        part = part.filter(pc.equal(pc.fill_null(pc.list_value_length(part.column("vector")), -1), d))
        c = np.asarray(pc.fill_null(part.column("vector").flatten(), float("nan"))).reshape(part.num_rows, d)
        good = np.isfinite(c).all(1)
        with np.errstate(over="ignore"):
            x = np.clip(np.floor(scale * c[good]), -MOST, MOST)
        yield part.column("vec_id").filter(pa.array(good)), x.astype(np.int64) + add


def whitening_of(scatter: Scatter) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvectors (columns), eigenvalues in falling order, and the trace of the covariance; signs make the largest entry positive."""
    square = scatter.n**2
    v = np.array([[float(m / square) if square else 0.0 for m in row] for row in scatter.numerator()], float).reshape(scatter.d, scatter.d)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(scatter.d)]) if scatter.d else np.ones(0)
    return vectors * signs, values, float(np.trace(v))


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(n * x - S) / n as doubles, and the exact sum of squares of n * x - S for each row, in decimal digits."""
    top = max((abs(int(s)) for s in sums), default=0) + n * max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if top < 1 << 62:
        diff = n * x - sums.astype(np.int64)
        limbs = [v.astype(np.int64) for v in _limbs(diff)]
        total = np.zeros(len(x), object)
        for a, left in enumerate(limbs):
            for b, right in enumerate(limbs):
                total += (left * right).sum(1).astype(object) << (LIMB * (a + b))
        return diff / n, [str(v) for v in total]
    diff = n * x.astype(object) - sums
    return (diff / n).astype(float), [str(v) for v in (diff * diff).sum(1)]


def _added(rows: DataFrame, d: int) -> Scatter:
    """The sum of all tasks' rows, FAN of them at a time, so that no task and not the driver gets them all."""

    def add(batches):
        total = Scatter(d)
        for b in batches:
            for r in b.to_pylist():
                total.take(r["n"], r["sums"], r["crosses"])
        yield total.row()

    n = rows.count()
    while n > 1:
        n = -(-n // FAN)
        rows = save(rows.repartition(n).mapInArrow(add, rows.schema), "added")
    total = Scatter(d)
    for r in rows.collect():  # one row
        total.take(r.n, r.sums, r.crosses)
    return total


def whiten(vectors: DataFrame, components: int = 8, scale: float = 1024.0, offset: int = 100_000, shift: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable row of vectors and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Usable rows have a vector without null or non-finite entries whose length is that of most vectors (the longest of equally
    frequent ones); all others, null and empty vectors among them, are left out. An entry c becomes x = floor(scale * c) + offset,
    from which shift (by default the offset) is subtracted before the sums: numbers stay small, and no result depends on it.
    floor(scale * c) stops at +-2 ** 62. n: the usable rows. deviation: the exact sum over the dimensions of (n * x - S) ** 2 in decimal digits, S
    being the sum of all x. Components are the unit eigenvectors of the covariance of x (divisor n), by falling eigenvalue, no
    more than the vectors have entries, signed so that their largest entry is positive. whitened: (x - S / n) along the component,
    by the square root of its eigenvalue; null where that is 0 (below FLAT of the trace), as with one row or equal rows.
    explained: the eigenvalue's share of the trace, 0 if all rows are equal. identity_error: the largest absolute entry of the
    covariance of the whitened values, which is measured on them, less the identity; null without any. Repeated rows and
    repeated or null ids stand for themselves; other columns, whatever their names, are not read. What the driver
    decomposes is a matrix of the dimension, whatever the number of rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    sizes = rows.where("size(vector) > 0").groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    out = "vec_id long, component int, n long, deviation string, whitened double, explained double, identity_error double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], out)
    d, add = sizes.d, offset - (offset if shift is None else shift)

    def scatter(batches):
        total = Scatter(d)
        for b in batches:
            for _, x in integers(b, d, scale, add):
                total.add(x)
        yield total.row()

    total = _added(save(rows.mapInArrow(scatter, "n long, sums array<string>, crosses array<string>"), "scatter"), d)
    vecs, values, trace = whitening_of(total)
    k, n, sums = min(components, d), total.n, total.sums
    live = [bool(v > FLAT * trace) for v in values[:k]]
    project = vecs[:, :k] / np.sqrt(np.where(live, values[:k], 1.0))

    def apply(batches):
        for b in batches:
            for ids, x in integers(b, d, scale, add):
                if len(ids):
                    centred, deviation = _deviations(x, n, sums)
                    w = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(ids) + 1, k), pa.int32()), pa.array((centred @ project).ravel()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(deviation, pa.string()), w], ["vec_id", "deviation", "w"])

    found = save(rows.mapInArrow(apply, "vec_id long, deviation string, w array<double>"), "whitened")
    share = [max(float(v), 0.0) / trace if trace > 0 else 0.0 for v in values[:k]]
    spread = F.posexplode("w").alias("component", "whitened")
    rows = found.select("vec_id", "deviation", spread)
    alive = F.element_at(F.array(*map(F.lit, live)), F.col("component") + 1)
    return rows.select(
        "vec_id", (F.col("component") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(alive, F.col("whitened")).alias("whitened"),
        F.element_at(F.array(*map(F.lit, share)), F.col("component") + 1).alias("explained"), F.lit(identity_error(found, live, n)).cast("double").alias("identity_error"),
    )


def identity_error(found: DataFrame, live: list[bool], n: int) -> float | None:
    """The largest absolute entry of the covariance of w's live places, centred first, less the identity."""
    at = [i for i, ok in enumerate(live) if ok]
    if not at or not n:
        return None
    w = lambda i: F.element_at("w", i + 1)
    mean = found.agg(*(F.avg(w(i)) for i in at)).first()
    less = [w(i) - F.lit(m) for i, m in zip(at, mean)]
    pairs = [(a, b) for a in range(len(at)) for b in range(a, len(at))]
    cov = found.agg(*(F.avg(less[a] * less[b]) for a, b in pairs)).first()
    return max(abs(c - (a == b)) for (a, b), c in zip(pairs, cov))
