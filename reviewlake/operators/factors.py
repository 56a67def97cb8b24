"""Truncated singular value decomposition of the users by items matrix, by block Lanczos steps on distributed vectors.

The matrix stays a table of pairs and each basis vector a column over the items: multiplying by A'A is two joins with sums, and all
that the driver sees are small matrices of the size of the basis.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import save
from .ranking import top_k, vector_topk


class Factors(NamedTuple):
    """users: user_id, vector; items: item, vector; values: the singular values. A score is the dot product of two vectors."""

    users: DataFrame
    items: DataFrame
    values: list[float]


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.asarray(batch.column(column).flatten(), float).reshape(batch.num_rows, -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


def inner(rows: DataFrame, left: str, right: str, shape: tuple[int, int]) -> np.ndarray:
    """left' right over all rows of two array columns: a product of matrices for each Arrow batch, a sum for each task."""

    def run(batches):
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += _matrix(b, left).T @ _matrix(b, right)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "x"])

    out = np.zeros(shape[0] * shape[1])
    sums = rows.select(left, right) if left != right else rows.select(left)
    for r in sums.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    return out.reshape(shape)


def _times(rows: DataFrame, out: str, parts: list[tuple[str, np.ndarray]], keep: list[str]) -> DataFrame:
    """rows' columns `keep` and out: the sum of array columns times small matrices."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = sum(_matrix(b, c) @ m for c, m in parts)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), _lists(x)], [*keep, out])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{schema}, {out} array<double>")


def _summed(pairs: DataFrame, by: str, to: str, vectors: DataFrame, column: str, width: int) -> DataFrame:
    """to, column: for each value of `to` the sum of the vectors of the pairs' `by`; partial sums are made before the shuffle."""
    met = pairs.join(vectors.select(by, *(F.col(column)[i].alias(f"c{i}") for i in range(width))), by)
    sums = met.groupBy(to).agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(width)))
    return sums.select(to, F.array(*(f"c{i}" for i in range(width))).alias(column))


def _start(items: DataFrame, width: int, seed: int) -> DataFrame:
    """item, w: normal draws that the item and the seed decide."""
    u = lambda i: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(i), "item"), 11) + 0.5) / F.lit(float(2**53))
    return items.select("item", F.array(*(F.sqrt(-2 * F.log(u(2 * i))) * F.cos(2 * np.pi * u(2 * i + 1)) for i in range(width))).alias("w"))


def _orthonormal(gram: np.ndarray, floor: float) -> np.ndarray:
    """m such that the vectors with this Gram matrix, times m, are orthonormal; directions of length floor or less are left out."""
    values, vectors = np.linalg.eigh(gram)
    good = values > max(floor**2, 0.0)
    return vectors[:, good] / np.sqrt(values[good])


def truncated_svd(rows: DataFrame, factors: int = 64, seed: int = 42, extra: int = 16, tolerance: float = 1e-10, most_steps: int = 40) -> Factors:
    """The best approximation of rank `factors` of the 0/1 matrix of rows' pairs (user_id, item), repeats counted once.

    The rank is at most the smaller side of the matrix less 1, and at least 1. A basis of item vectors grows by a block of
    factors + extra vectors a step: A'A times the last block, made orthogonal to all before it (twice) by small matrices. The
    leading eigenvectors within the basis are taken when their residuals are below tolerance times the first eigenvalue, or
    when nothing new is left; RuntimeError after most_steps. Without rows there are no vectors. Each step is a written table.
    """
    pairs = save(rows.select("user_id", "item").distinct(), "pairs")
    n_users, n_items = pairs.agg(F.countDistinct("user_id"), F.countDistinct("item")).first()
    if not n_items:
        empty = F.array().cast("array<double>").alias("vector")
        return Factors(pairs.select("user_id", empty), pairs.select("item", empty), [])
    k = max(1, min(factors, min(n_users, n_items) - 1))
    width = min(k + extra, n_items)
    block = save(_start(pairs.select("item").distinct(), width, seed), "start")
    m = _orthonormal(inner(block, "w", "w", (width, width)), 1e-8)
    # v: all of the basis, q: its last block.
    basis = save(_times(block, "q", [("w", m)], ["item"]).select("item", F.col("q").alias("v"), "q"), "basis")
    size = last = m.shape[1]
    small = np.zeros((0, 0))
    for _ in range(most_steps):
        users = _summed(pairs, "item", "user_id", basis, "q", last)
        image = _summed(pairs, "user_id", "item", users, "q", last).withColumnRenamed("q", "w")
        both = save(basis.join(image, "item").select("item", "v", "w"), "image")
        h = inner(both, "v", "w", (size, last))
        grown = np.zeros((size, size))
        grown[: len(small), : len(small)] = small
        grown[:, size - last :] = h
        grown[size - last :, :] = h.T
        small = (grown + grown.T) / 2
        values, vectors = np.linalg.eigh(small)
        values, vectors = values[::-1], vectors[:, ::-1]
        top = max(float(values[0]), 1e-300)
        rest = save(_times(both, "w", [("w", np.eye(last)), ("v", -h)], ["item", "v"]), "rest")
        again = inner(rest, "v", "w", (size, last))
        rest = save(_times(rest, "w", [("w", np.eye(last)), ("v", -again)], ["item", "v"]), "rest")
        gram = inner(rest, "w", "w", (last, last))
        # The rest's part in a Ritz vector is what is missing to an eigenvector.
        tail = vectors[size - last :, :k]
        residual = np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", tail, gram, tail), 0.0))
        m = _orthonormal(gram, 1e-9 * top)
        if size >= k and (residual.max(initial=0.0) <= tolerance * top or not m.shape[1] or size >= n_items):
            found = save(_times(basis, "vector", [("v", vectors[:, :k])], ["item"]), "items")
            return Factors(save(_summed(pairs, "item", "user_id", found, "vector", k), "users"), found, np.sqrt(np.maximum(values[:k], 0.0)).tolist())
        basis = _times(rest, "q", [("w", m)], ["item", "v"])
        basis = save(basis.select("item", F.concat("v", "q").alias("v"), "q"), "basis")
        last = m.shape[1]
        size += last
    raise RuntimeError(f"no {k} singular vectors within {most_steps} steps")


def factor_scores(candidates: DataFrame, model: Factors) -> DataFrame:
    """candidates: user_id, item, ... Adds score: the dot product of both vectors; unknown users and items score 0."""
    rows = candidates.join(model.users.withColumnRenamed("vector", "_u"), "user_id", "left").join(model.items.withColumnRenamed("vector", "_v"), "item", "left")
    dot = F.aggregate(F.zip_with("_u", "_v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return rows.select(*candidates.columns, F.coalesce(dot, F.lit(0.0)).alias("score"))


def factor_best(model: Factors, users: DataFrame, k: int, excluded: DataFrame | None = None) -> DataFrame:
    """user_id, item, score, rank: each known user's k best items, ties (at 12 decimals) by item, without excluded ones (user_id, item).

    Vectors meet in blocks, a product of matrices each; users keep k and as many more as they have excluded items.
    """
    asked = model.users.join(users.select("user_id").distinct(), "user_id", "left_semi").withColumnRenamed("vector", "query")
    if excluded is None:
        return vector_topk(asked, model.items, k, "dot")
    out = excluded.select("user_id", "item").distinct()
    many = out.groupBy("user_id").agg(F.count("*").alias("more"))
    asked = asked.join(many, "user_id", "left").withColumn("more", F.coalesce("more", F.lit(0)))
    lists = vector_topk(asked, model.items, k, "dot", more="more").drop("rank").join(out, ["user_id", "item"], "left_anti")
    return top_k(lists, k, ["user_id"], [F.desc("score"), "item"])
