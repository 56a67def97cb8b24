import numpy as np
import pytest

from reviewlake.operators import factors


def matrix_of(rows):
    users, items = sorted({u for u, _ in rows}), sorted({i for _, i in rows})
    a = np.zeros((len(users), len(items)))
    for u, i in rows:
        a[users.index(u), items.index(i)] = 1
    return users, items, a


def cut(a, k):
    u, s, v = np.linalg.svd(a, full_matrices=False)
    return (u[:, :k] * s[:k]) @ v[:k], s[:k]


@pytest.mark.parametrize("k, extra", [(3, 2), (6, 3), (40, 4)])
def test_scores_like_numpy(spark, k, extra):
    draw = np.random.default_rng(k)
    rows = [(f"u{u}", f"i{i}") for u in range(30) for i in range(18) if draw.random() < 0.15 + 0.5 * (u % 4 == i % 4)]
    users, items, a = matrix_of(rows)
    model = factors.truncated_svd(spark.createDataFrame(rows * 2, "user_id string, item string"), k, extra=extra)
    want, values = cut(a, min(k, len(items) - 1))
    assert np.allclose(model.values, values, atol=1e-8)
    every = spark.createDataFrame([(u, i) for u in [*users, "new"] for i in [*items, "none"]], "user_id string, item string")
    for r in factors.factor_scores(every, model).collect():
        assert abs(r.score - (want[users.index(r.user_id), items.index(r.item)] if r.user_id in users and r.item in items else 0)) < 1e-6


def test_known_low_rank_and_lists(spark):
    """Three blocks of equal rows: rank 3, so three factors give the matrix back, and the steps end when nothing is left."""
    rows = [(f"u{u}", f"i{i}") for u in range(21) for i in range(12) if u % 3 == i % 3 and (u % 3, i) != (0, 9)]
    users, items, a = matrix_of(rows)
    df = spark.createDataFrame(rows, "user_id string, item string")
    model = factors.truncated_svd(df, 3)
    got = {(r.user_id, r.item): r.score for r in factors.factor_scores(df, model).collect()}
    assert all(abs(s - 1) < 1e-8 for s in got.values()) and np.allclose(sorted(model.values), sorted(np.sqrt([7 * 3, 7 * 4, 7 * 4])))
    lists = factors.factor_best(model, df, 4, df.where("user_id = 'u1' and item in ('i1', 'i4')")).collect()
    by = {u: [r.item for r in sorted(lists, key=lambda r: r["rank"]) if r.user_id == u] for u in users}
    assert set(by["u2"]) == {"i2", "i5", "i8", "i11"} and set(by["u1"][:2]) == {"i7", "i10"} and len(by["u1"]) == 4


def test_few_rows(spark):
    schema = "user_id string, item string"
    none = factors.truncated_svd(spark.createDataFrame([], schema))
    assert none.users.count() == 0 and factors.factor_scores(spark.createDataFrame([("u", "i")], schema), none).first().score == 0
    one = factors.truncated_svd(spark.createDataFrame([("u", "i")], schema))
    assert np.allclose(one.values, [1.0]) and abs(factors.factor_scores(spark.createDataFrame([("u", "i")], schema), one).first().score - 1) < 1e-9


def test_query_like_numpy(spark):
    from reviewlake.plans import tables as T
    from reviewlake.plans.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    users, items, a = matrix_of({(r.user_id, r.item) for r in T.signals(spark, sf).collect()})
    want, _ = cut(a, 8)
    got = QUERIES["svd_topk"](spark, sf).collect()
    assert len(got) == 20 * len(users)
    for r in got:
        row = want[users.index(r.user_id)]
        assert abs(r.score - row[items.index(r.item)]) < 2e-6 and abs(np.sort(row)[-r["rank"]] - r.score) < 2e-6
