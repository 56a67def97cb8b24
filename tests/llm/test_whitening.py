import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from reviewlake.llm import whitening as W
from reviewlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, k=8, scale=1024):
    """By id: (exact deviation, |whitened|) and the shares; whitened by numpy's singular values of the centred rows."""
    rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    d = max(Counter(len(v) for _, v in rows).items(), key=lambda x: (x[1], x[0]))[0]
    rows = [(i, v) for i, v in rows if len(v) == d]
    x = [[math.floor(Fraction(scale) * Fraction(c)) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in x])
    u, s, _ = np.linalg.svd(centred, full_matrices=False)
    return [i for i, _ in rows], deviation, np.abs(u[:, :k] * math.sqrt(n)), (s**2 / (s**2).sum())[:k] if s.any() else np.zeros(min(k, d))


def check(got, want, k):
    ids, deviation, whitened, share = want
    assert len(got) == len(ids) * k and {r.n for r in got} == {len(ids)}
    by = {(r.vec_id, r.component): r for r in got}
    for i, dev, w in zip(ids, deviation, whitened):
        for c in range(k):
            r = by[i, c + 1]
            assert int(r.deviation) == dev and abs(abs(r.whitened) - w[c]) < 1e-6 and abs(r.explained / share[c] - 1) < 1e-6
    assert got[0].identity_error < 1e-8 and len({r.identity_error for r in got}) == 1


SCHEMA = "vec_id long, embedding array<double>, w int, component string, vector int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("shift", [None, 0, -12345])
def test_same_as_brute_force(spark, shift):
    draw = np.random.default_rng(1)
    rows = [(i, (draw.normal(size=12) * np.arange(1, 13) + 50).tolist()) for i in range(70)]
    bad = [(100, None), (101, []), (102, [1.0] * 11), (103, [float("nan")] + [1.0] * 11), (104, [float("inf")] + [1.0] * 11), (105, [None] + [1.0] * 11)]
    check(W.whiten(frame(spark, rows + bad), shift=shift).collect(), brute(rows), 8)


def test_sizes_of_numbers_and_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 16)
    monkeypatch.setattr(W, "FOLD", 2)
    monkeypatch.setattr(W, "FAN", 2)
    draw = np.random.default_rng(2)
    for size in (1.0, 1e5, 1e13):
        rows = [(i, (draw.normal(size=3) * size).tolist()) for i in range(90)]
        check(W.whiten(frame(spark, rows), components=8).collect(), brute(rows), 3)
    total = W.Scatter(2)
    x = draw.integers(-(1 << 62), 1 << 62, (100, 2))
    total.add(x)
    assert total.numerator().tolist() == [[100 * sum(int(r[a]) * int(r[b]) for r in x) - sum(map(int, x[:, a])) * sum(map(int, x[:, b])) for b in (0, 1)] for a in (0, 1)]
    huge = W.whiten(frame(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])])).collect()
    assert len(huge) == 6 and int(huge[0].deviation) > 1 << 63


def test_flat_and_few_rows(spark):
    assert W.whiten(frame(spark, [])).count() == 0
    assert W.whiten(frame(spark, [(1, None), (2, []), (3, [float("nan")])])).count() == 0
    for rows in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 40):
        got = W.whiten(frame(spark, rows)).collect()
        assert len(got) == 2 * len(rows) and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {("0", None, 0.0, None)}
    line = W.whiten(frame(spark, [(i, [float(i), 2.0 * i, 3.0]) for i in range(10)] + [(None, [3.0, 6.0, 3.0])] * 2)).collect()
    assert len(line) == 36 and all((r.whitened is None) == (r.component > 1) for r in line) and line[0].identity_error < 1e-9
    ties = W.whiten(frame(spark, [(1, [1.0]), (2, [3.0]), (3, [1.0, 2.0]), (4, [2.0, 1.0])])).collect()
    assert {r.vec_id for r in ties} == {3, 4}


def test_query_like_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = QUERIES["op13_embedding_whitening"](spark, SF)
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["component"] == "int"
    check(got.collect(), brute(rows), 8)
