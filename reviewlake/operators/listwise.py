"""Softmax models over lists, fitted for all folds at once by limited-memory quasi-Newton steps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import save


def fold_of(folds: int, seed: int) -> Column:
    """A user's fold, from a hash: the same for all rows of the user."""
    return F.pmod(F.xxhash64(F.lit(seed), "user_id"), F.lit(folds)).cast("int")


def minimise(objective: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], start: np.ndarray, passes: int = 80, memory: int = 10, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of start, each moved to a minimum of its own; (points, values, calls of objective, `passes` at most).

    objective: points to values and gradients of all rows. Directions come from the last `memory` steps by the two-loop recursion;
    a step that does not lower its row's value enough is shortened in the next pass, in which the other rows go on.
    """
    x, (value, grad) = start.copy(), objective(start)
    calls, n = 1, len(start)
    steps: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
    length, direction = np.ones(n), -grad / np.maximum(1.0, np.linalg.norm(grad, axis=1, keepdims=True))
    done = np.abs(grad).max(axis=1, initial=0.0) <= tolerance
    while calls < passes and not done.all():
        tried = np.where(done[:, None], x, x + length[:, None] * direction)
        new_value, new_grad = objective(tried)
        calls += 1
        for i in np.flatnonzero(~done):
            if new_value[i] > value[i] + 1e-4 * length[i] * (grad[i] @ direction[i]):
                length[i] /= 2.5
                done[i] = length[i] < 1e-9
                continue
            s, y = tried[i] - x[i], new_grad[i] - grad[i]
            if s @ y > 1e-12:
                steps[i] = [*steps[i], (s, y)][-memory:]
            x[i], value[i], grad[i] = tried[i], new_value[i], new_grad[i]
            direction[i], length[i] = -_scaled(grad[i], steps[i]), 1.0
            done[i] = np.abs(grad[i]).max(initial=0.0) <= tolerance
    return x, value, calls


def _scaled(grad: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The gradient times an approximate inverse of the curvature that the steps show."""
    if not steps:
        return grad / max(1.0, np.linalg.norm(grad))
    q, shares = grad.copy(), []
    for s, y in reversed(steps):
        a = (s @ q) / (s @ y)
        q = q - a * y
        shares.append(a)
    s, y = steps[-1]
    q = q * ((s @ y) / (y @ y))
    for (s, y), a in zip(steps, reversed(shares)):
        q = q + s * (a - (y @ q) / (s @ y))
    return q


def _packed(rows: DataFrame, features: tuple[str, ...], folds: int, seed: int, size: int) -> DataFrame:
    """fold, x, y, ends: a row for each `size` rows or so of whole lists of a fold, as matrices; lists without gold are left out."""
    fold = fold_of(folds, seed) if folds > 1 else F.lit(-1)
    made = rows.select(fold.alias("fold"), F.col("user_id"), (F.col("label") > 0).alias("gold"), F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features)).alias("x"))
    dealt = made.repartition("fold", "user_id").sortWithinPartitions("fold", "user_id")
    n = len(features)

    def run(batches):
        x, y, ends, user, at, width = [], [], [], None, None, 0
        # Rows of the list that is being read, which joins the block when it ends.
        rows_x, rows_y = [], []

        def close():
            nonlocal rows_x, rows_y, width
            if any(rows_y):
                x.extend(rows_x)
                y.extend(rows_y)
                width += len(rows_y)
                ends.append(width)
            rows_x, rows_y = [], []

        def block():
            nonlocal x, y, ends, width
            if ends:
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.concatenate(x).ravel()], pa.list_(pa.float64())), pa.array([y], pa.list_(pa.bool_())), pa.array([ends], pa.list_(pa.int32()))], ["fold", "x", "y", "ends"])
            x, y, ends, width = [], [], [], 0

        for b in batches:
            users, gold, fold = (b.column(c).to_pylist() for c in ("user_id", "gold", "fold"))
            values = np.asarray(b.column("x").flatten(), float).reshape(b.num_rows, n)
            for i in range(b.num_rows):
                if (users[i], fold[i]) != (user, at) or not (rows_x or ends):
                    close()
                    if width >= size or fold[i] != at:
                        yield from block()
                    user, at = users[i], fold[i]
                rows_x.append(values[i : i + 1])
                rows_y.append(bool(gold[i]))
        close()
        yield from block()

    return dealt.mapInArrow(run, "fold int, x array<double>, y array<boolean>, ends array<int>")


def fit_folds(rows: DataFrame, features: tuple[str, ...], folds: int = 1, l2: float = 0.1, passes: int = 80, seed: int = 42, start: str = "neg_log_rank", size: int = 4096) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(w, mean, sd) for each fold, of a softmax over the lists of all other folds (of all lists, if there is one fold).

    rows: user_id, label (gold > 0) and the features, null as 0. The loss is the mean over lists with gold items of -log of their
    share, plus l2 times the squared weights; features are standardised by all rows of those folds. Lists are packed into
    matrices and written once; each pass, `passes` at most, sums the loss and gradient of every fold's model in the tasks, and the
    driver gets one short row. A list has to fit into memory, as pools do.
    """
    n = len(features)
    fold = (fold_of(folds, seed) if folds > 1 else F.lit(0)).alias("fold")
    sums = rows.groupBy(fold).agg(F.count("*").alias("n"), *(F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"s{i}") for i, c in enumerate(features)))
    per = {r["fold"]: np.array([r["n"], *(r[f"s{i}"] for i in range(n))]) for r in sums.collect()}
    whole = sum(per.values(), np.zeros(n + 1))
    used = [whole - (per.get(k, np.zeros(n + 1)) if folds > 1 else 0) for k in range(folds)]
    mu = np.array([u[1:] / max(u[0], 1) for u in used])
    # Squares are taken around the overall mean, so that nothing is lost to large means.
    centre = whole[1:] / max(whole[0], 1)
    squares = rows.groupBy(fold).agg(*(F.sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(float(m))) ** 2).alias(f"s{i}") for i, (c, m) in enumerate(zip(features, centre))))
    per2 = {r["fold"]: np.array([r[f"s{i}"] for i in range(n)]) for r in squares.collect()}
    total2 = sum(per2.values(), np.zeros(n))
    var = np.array([(total2 - (per2.get(k, np.zeros(n)) if folds > 1 else 0)) / max(used[k][0], 1) - (mu[k] - centre) ** 2 for k in range(folds)])
    sd = np.sqrt(np.maximum(var, 0.0))
    sd[sd < 1e-9] = 1.0
    lists = save(_packed(rows, features, folds, seed, size), "lists")

    def objective(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def run(batches):
            out = np.zeros((folds, n + 2))
            for b in batches:
                for r in range(b.num_rows):
                    x = np.asarray(b.column("x")[r].values, float).reshape(-1, n)
                    y, ends, own = np.asarray(b.column("y")[r].values.to_numpy(False), bool), np.asarray(b.column("ends")[r].values), b.column("fold")[r].as_py()
                    heads = np.concatenate([[0], ends[:-1]])
                    for k in range(folds):
                        if k == own:
                            continue
                        s = (x - mu[k]) @ (w[k] / sd[k])
                        e = np.exp(s - np.repeat(np.maximum.reduceat(s, heads), np.diff(np.append(heads, ends[-1]))))
                        z, g = np.add.reduceat(e, heads), np.maximum(np.add.reduceat(np.where(y, e, 0.0), heads), 1e-12)
                        span = np.diff(np.append(heads, ends[-1]))
                        pull = e / np.repeat(z, span) - np.where(y, e / np.repeat(g, span), 0.0)
                        out[k, 0] += len(ends)
                        out[k, 1] -= np.log(np.maximum(g / z, 1e-12)).sum()
                        out[k, 2:] += pull @ ((x - mu[k]) / sd[k])
            yield pa.RecordBatch.from_arrays([pa.array([out.ravel()], pa.list_(pa.float64()))], ["sums"])

        parts = lists.mapInArrow(run, "sums array<double>")
        got = np.array([v or 0.0 for v in parts.agg(*(F.sum(F.col("sums")[i]) for i in range(folds * (n + 2)))).first()], float).reshape(folds, n + 2)
        count = np.maximum(got[:, 0], 1)
        return got[:, 1] / count + l2 * (w * w).sum(1), got[:, 2:] / count[:, None] + 2 * l2 * w

    first = np.zeros((folds, n))
    if start in features:
        first[:, features.index(start)] = 1.0
    w, _, _ = minimise(objective, first, passes)
    return [(w[k], mu[k], sd[k]) for k in range(folds)]
