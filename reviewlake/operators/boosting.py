"""Gradient-boosted trees for P(label), grown for all folds at once from histograms of binned features."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import save
from .listwise import fold_of

#: Grown trees that are still applied on the fly before the rows' raw scores are written anew.
KEEP = 10
#: So many rows, or a few more, are a block, which a task sums up at once.
SLICE = 1 << 15


class Tree:
    """A binary tree of nodes 0, 1 and 2 below it, and so on: feature (-1: a leaf), the last bin that goes left, and the value."""

    def __init__(self, depth: int):
        size = 2 ** (depth + 1) - 1
        self.feature, self.bin, self.value = np.full(size, -1), np.zeros(size, int), np.zeros(size)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        at = np.zeros(len(bins), int)
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return at
            rows = np.flatnonzero(inner)
            here = at[rows]
            at[rows] = 2 * here + 1 + (bins[rows, self.feature[here]] > self.bin[here])


class Forest:
    """cuts: ascending numbers per feature; base: the raw score before any tree."""

    def __init__(self, cuts: list[np.ndarray], base: float):
        self.cuts, self.base, self.trees = cuts, base, []

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.cuts)
        return self.base + sum((t.value[t.nodes(bins)] for t in self.trees), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Per feature, how many cuts are below the value; a missing value is below all."""
    return np.stack([np.where(np.isnan(x[:, f]), 0, np.searchsorted(c, x[:, f], "left")) for f, c in enumerate(cuts)], axis=1) if cuts else np.zeros((len(x), 0), int)


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, l2: float, least: int) -> tuple[int, int]:
    """Of a node's sums by (feature, bin): the split with the greatest gain, the first of equals; feature -1 if none gains."""
    gl, hl, nl = (np.cumsum(v, axis=1)[:, :-1] for v in (g, h, n))
    gr, hr, nr = g.sum(1, keepdims=True) - gl, h.sum(1, keepdims=True) - hl, n.sum(1, keepdims=True) - nl
    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - (g.sum(1) ** 2 / (h.sum(1) + l2))[:, None]
    gain = np.where((nl >= least) & (nr >= least), gain, -np.inf)
    if not gain.size or gain.max() <= 1e-9:
        return -1, 0
    # Sums come in any order: gains that differ in the last digits only are equal.
    at = int(np.flatnonzero(gain.ravel() >= gain.max() * (1 - 1e-9))[0])
    return at // gain.shape[1], at % gain.shape[1]


def slices(batches):
    """The rows of small batches in batches of SLICE rows or so, as a histogram costs the same for few rows as for many."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= SLICE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def cuts_of(rows: DataFrame, features: tuple[str, ...], bins: int) -> list[np.ndarray]:
    """At most bins - 1 ascending numbers per feature between its values, near its quantiles."""
    shares = [i / bins for i in range(1, bins)]
    got = rows.agg(*(F.percentile_approx(F.col(c).cast("double"), shares, 20 * bins).alias(f"c{i}") for i, c in enumerate(features))).first()
    return [np.unique(np.array(got[f"c{i}"] or [], float)) for i in range(len(features))]


def fit_forests(rows: DataFrame, features: tuple[str, ...], folds: int = 5, trees: int = 60, rate: float = 0.08, depth: int = 4, least: int = 80, l2: float = 0.15, pos_weight: float = 25.0, bins: int = 128, seed: int = 42) -> list[Forest]:
    """For each fold, logistic boosting on the rows of all other folds (of all rows, if there is one fold): Forest.

    rows: user_id, label (> 0 is positive, with weight pos_weight) and the features. Rows are binned and written once. For each
    level of a tree one pass sums gradients and curvatures by (fold, node, feature, bin), first within the tasks; what the
    driver splits by is bounded by these four numbers, whatever the number of rows.
    """
    cuts = cuts_of(rows, features, bins)
    wide = max([len(c) for c in cuts], default=0) + 1
    made = rows.select((fold_of(folds, seed) if folds > 1 else F.lit(-1)).cast("int").alias("fold"), (F.coalesce(F.col("label"), F.lit(0)) > 0).alias("y"), F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features)).alias("x"))
    nf = len(features)
    own = [k if folds > 1 else -2 for k in range(folds)]

    def matrix(b: pa.RecordBatch, c: str, kind=float) -> np.ndarray:
        return np.asarray(b.column(c).flatten(), kind).reshape(b.num_rows, -1)

    counts = {(r["fold"], r["y"]): r["count"] for r in made.groupBy("fold", "y").count().collect()}
    base = []
    for k in own:
        up, down = (sum((v for (f, y), v in counts.items() if f != k and y == side), 0) for side in (True, False))
        base.append(float(np.log(pos_weight * up / down)) if up and down else (12.0 if up else -12.0))
    forests = [Forest(cuts, b) for b in base]

    def block(fold: np.ndarray, y: np.ndarray, bins: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
        cells = (np.ascontiguousarray(v, t).tobytes() for v, t in ((fold, np.int32), (y, bool), (bins, np.int16), (raw, float)))
        return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], ["n", "fold", "y", "bins", "raw"])

    def blocks(batches):
        for b in batches:
            for i in range(b.num_rows):
                n = b.column("n")[i].as_py()
                yield tuple(np.frombuffer(b.column(c)[i].as_py() or b"", t).reshape(n, *wide) for c, t, wide in (("fold", np.int32, ()), ("y", bool, ()), ("bins", np.int16, (nf,)), ("raw", float, (folds,))))

    def first(batches):
        for b in slices(batches):
            x, n = binned(matrix(b, "x"), cuts), b.num_rows
            yield block(np.asarray(b.column("fold")), np.asarray(b.column("y").to_numpy(False), bool), x, np.tile(base, (n, 1)))

    # A row has the folds, labels, bins and raw scores of SLICE rows as bytes: each pass reads them all, and they need no conversion.
    schema = "n int, fold binary, y binary, bins binary, raw binary"
    table = save(made.mapInArrow(first, schema), "binned")
    written = 0

    def advanced(raw: np.ndarray, bins: np.ndarray, since: int, upto: int) -> np.ndarray:
        raw = raw.copy()
        for k in range(folds):
            for t in forests[k].trees[since:upto]:
                raw[:, k] += t.value[t.nodes(bins)]
        return raw

    for nth in range(trees):
        growing = [Tree(depth) for _ in range(folds)]
        if nth - written >= KEEP:
            since, upto = written, nth

            def again(batches, since=since, upto=upto):
                for fold, y, bins, raw in blocks(batches):
                    yield block(fold, y, bins, advanced(raw, bins, since, upto))

            table, written = save(table.mapInArrow(again, schema), "binned"), nth
        open_nodes = [{0} for _ in range(folds)]
        for level in range(depth + 1):
            if not any(open_nodes):
                break
            low, many = 2**level - 1, 2**level

            def histograms(batches, since=written, upto=nth, low=low, many=many, growing=growing, open_nodes=open_nodes):
                sums = np.zeros((3, folds, nf, many * wide))
                for fold, y, bins, raw in blocks(batches):
                    raw = advanced(raw, bins, since, upto)
                    for k in range(folds):
                        at = growing[k].nodes(bins)
                        use = np.flatnonzero((fold != own[k]) & np.isin(at, list(open_nodes[k])))
                        p, w = 1 / (1 + np.exp(-raw[use, k])), np.where(y[use], pos_weight, 1.0)
                        g, h, cell, mine = w * (p - y[use]), w * p * (1 - p), (at[use] - low) * wide, bins[use]
                        for f in range(nf):
                            key = cell + mine[:, f]
                            for i, v in enumerate((g, h, None)):
                                sums[i, k, f] += np.bincount(key, v, many * wide)
                # From fold, feature, node, bin to fold, node, feature, bin.
                sums = sums.reshape(3, folds, nf, many, wide).swapaxes(2, 3).reshape(3, -1)
                hit = np.flatnonzero(sums[2])
                yield pa.RecordBatch.from_arrays([pa.array(hit), *(pa.array(s[hit]) for s in sums)], ["at", "g", "h", "n"])

            found = table.mapInArrow(histograms, "at long, g double, h double, n double").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas()
            cells = np.zeros((3, folds * many * nf * wide))
            for i, c in enumerate("ghn"):
                cells[i, found["at"]] = found[c]
            cells = cells.reshape(3, folds, many, nf, wide)
            for k in range(folds):
                later = set()
                for node in sorted(open_nodes[k]):
                    g, h, n = cells[:, k, node - low]
                    tree = growing[k]
                    feature, cut = best_split(g, h, n, l2, least) if level < depth and nf else (-1, 0)
                    if feature >= 0:
                        tree.feature[node], tree.bin[node] = feature, cut
                        later |= {2 * node + 1, 2 * node + 2}
                    elif nf:
                        tree.value[node] = -rate * g[0].sum() / (h[0].sum() + l2)
                open_nodes[k] = later
        for k in range(folds):
            forests[k].trees.append(growing[k])
    return forests


def boosted_out_of_fold(rows: DataFrame, features: tuple[str, ...], folds: int = 5, seed: int = 42, **options) -> DataFrame:
    """rows with score: P(label > 0) by the forest that has not seen the row's user; one fold scores what it was fitted on."""
    forests = fit_forests(rows, features, folds, seed=seed, **options)

    @F.pandas_udf("double")
    def score(fold: pd.Series, x: pd.Series) -> pd.Series:
        out, values, fold = np.zeros(len(x)), np.array(x.tolist(), float).reshape(len(x), -1), fold.to_numpy()
        for k, forest in enumerate(forests):
            mine = np.flatnonzero(fold == k)
            if len(mine):
                out[mine] = forest.probability(values[mine])
        return pd.Series(out)

    fold = fold_of(folds, seed) if folds > 1 else F.lit(0)
    return rows.withColumn("score", score(fold, F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features))))
