import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.operators import boosting, features, listwise


def frame(spark, users=40, size=12, n=4, seed=1):
    draw = np.random.default_rng(seed)
    rows = []
    for u in range(users):
        x = draw.normal(size=(size, n)).round(3) * [1, 5, 0.1, 1] + [0, 100, 0, 0]
        y = draw.random(size) < 1 / (1 + np.exp(-(x[:, 0] * 1.5 - x[:, 2] * 10 - 1)))
        rows += [(f"u{u}", f"i{j}", int(y[j]), *map(float, x[j])) for j in range(size)]
    rows += [("none", f"i{j}", 0, 1.0, 99.0, 0.0, 0.0) for j in range(3)]
    return spark.createDataFrame(rows, "user_id string, item string, label int, a double, b double, c double, neg_log_rank double")


NAMES = ("a", "b", "c", "neg_log_rank")


def plain_loss(w, mu, sd, by_user, l2):
    total, grad, n = 0.0, np.zeros(len(w)), 0
    for x, y in by_user:
        if not y.any():
            continue
        z = (x - mu) / sd
        e = np.exp(z @ w - (z @ w).max())
        p, g = e / e.sum(), np.where(y, e, 0) / e[y].sum()
        total -= np.log(e[y].sum() / e.sum())
        grad += z.T @ (p - g)
        n += 1
    return total / n + l2 * w @ w, grad / n + 2 * l2 * w


def test_listwise_fit_like_plain_numpy(spark):
    df = frame(spark).repartition(6)
    pdf = df.toPandas()
    folds = {r.user_id: r.fold for r in df.select("user_id", listwise.fold_of(3, 42).alias("fold")).distinct().collect()}
    found = listwise.fit_folds(df, NAMES, folds=3, size=50)
    for k, (w, mu, sd) in enumerate(found):
        part = pdf[pdf["user_id"].map(folds) != k]
        x = part[list(NAMES)].to_numpy()
        assert np.allclose(mu, x.mean(0)) and np.allclose(sd, x.std(0))
        lists = [(g[list(NAMES)].to_numpy(), g["label"].to_numpy() > 0) for _, g in part.groupby("user_id")]
        v = np.zeros(4)
        for _ in range(20_000):  # plain gradient descent
            step = plain_loss(v, mu, sd, lists, 0.1)[1]
            v = v - 0.3 * step
            if np.abs(step).max() < 1e-9:
                break
        assert plain_loss(w, mu, sd, lists, 0.1)[0] - plain_loss(v, mu, sd, lists, 0.1)[0] < 1e-6 and np.allclose(w, v, atol=1e-4)
    scored = features.out_of_fold(df, 3, features=NAMES).toPandas()
    for k, (w, mu, sd) in enumerate(found):
        mine = scored[scored["user_id"].map(folds) == k]
        assert np.allclose(mine["score"], (mine[list(NAMES)].to_numpy() - mu) / sd @ w)


def test_quasi_newton_counts_passes():
    calls = []

    def objective(x):
        calls.append(1)
        return (x[:, 0] - 3) ** 2 + 50 * (x[:, 1] - x[:, 0]) ** 2, np.stack([2 * (x[:, 0] - 3) - 100 * (x[:, 1] - x[:, 0]), 100 * (x[:, 1] - x[:, 0])], 1)

    x, value, n = listwise.minimise(objective, np.array([[0.0, 0.0], [10.0, -4.0]]))
    assert np.allclose(x, 3, atol=1e-5) and n == len(calls) < 40 and value.max() < 1e-9
    assert listwise.minimise(objective, np.zeros((1, 2)), passes=3)[2] == 3


def plain_boosting(x, y, cuts, trees, rate, depth, least, l2, weight):
    bins = boosting.binned(x, cuts)
    w = np.where(y, weight, 1.0)
    raw = np.full(len(x), np.log(weight * y.sum() / (~y).sum()))
    base, out = raw[0], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h, tree = w * (p - y), w * p * (1 - p), {}

        def grow(rows, level):
            best = (1e-9, None)
            total = g[rows].sum() ** 2 / (h[rows].sum() + l2)
            for f in range(x.shape[1]) if level < depth else ():
                for c in range(max(len(k) for k in cuts)):
                    left, right = rows[bins[rows, f] <= c], rows[bins[rows, f] > c]
                    if min(len(left), len(right)) >= least:
                        gain = g[left].sum() ** 2 / (h[left].sum() + l2) + g[right].sum() ** 2 / (h[right].sum() + l2) - total
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (f, c, left, right))
            if best[1]:
                f, c, left, right = best[1]
                return (f, c, grow(left, level + 1), grow(right, level + 1))
            raw[rows] += -rate * g[rows].sum() / (h[rows].sum() + l2)
            return -rate * g[rows].sum() / (h[rows].sum() + l2)

        out.append(grow(np.arange(len(x)), 0))
    return base, out


def plain_raw(base, trees, bins):
    def walk(t, b):
        return t if not isinstance(t, tuple) else walk(t[2] if b[t[0]] <= t[1] else t[3], b)

    return np.array([base + sum(walk(t, b) for t in trees) for b in bins])


@pytest.mark.parametrize("folds", [1, 3])
def test_boosting_like_plain_numpy(spark, monkeypatch, folds):
    monkeypatch.setattr(boosting, "KEEP", 2)
    df = frame(spark, users=30, seed=folds).withColumn("a", F.expr("if(item = 'i3', null, a)")).repartition(5)
    options = dict(trees=5, rate=0.2, depth=3, least=10, l2=0.15, pos_weight=3.0, bins=8)
    forests = boosting.fit_forests(df, NAMES[:3], folds, **options)
    scored = boosting.boosted_out_of_fold(df, NAMES[:3], folds, **options).toPandas()
    fold = {r.user_id: r.fold for r in df.select("user_id", listwise.fold_of(folds, 42).alias("fold")).distinct().collect()}
    own = scored["user_id"].map(fold).to_numpy() if folds > 1 else np.full(len(scored), -1)
    x, y = scored[list(NAMES[:3])].to_numpy(float), scored["label"].to_numpy() > 0
    cuts = forests[0].cuts
    assert all(1 <= len(c) <= 7 for c in cuts)
    for k in range(folds):
        learn = own != k if folds > 1 else np.ones(len(x), bool)
        base, trees = plain_boosting(x[learn], y[learn], cuts, 5, 0.2, 3, 10, 0.15, 3.0)
        want = 1 / (1 + np.exp(-plain_raw(base, trees, boosting.binned(x, cuts))))
        mine = own == k if folds > 1 else learn
        assert np.allclose(scored["score"].to_numpy()[mine], want[mine]) and np.allclose(forests[k].probability(x), want)
    order = scored["score"].rank().to_numpy()
    auc = (order[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.6


def test_boosting_of_odd_tables(spark):
    df = frame(spark, users=3)
    assert boosting.boosted_out_of_fold(df.limit(0), NAMES, 2, trees=2).count() == 0
    one = boosting.boosted_out_of_fold(df.withColumn("label", F.lit(1)), NAMES, 2, trees=2).select("score").distinct().collect()
    assert all(r.score > 0.99 for r in one)
    assert boosting.boosted_out_of_fold(df, NAMES, 2, trees=2).select("score").where("score is null or score < 0 or score > 1").count() == 0


def test_boosting_saves_blocks_of_rows(spark, monkeypatch):
    saved, save = [], boosting.save
    monkeypatch.setattr(boosting, "save", lambda df, name: saved.append(save(df, name)) or saved[-1])
    df = frame(spark, users=30).repartition(2)
    boosting.fit_forests(df, NAMES[:3], 2, trees=1, depth=1, least=5)
    assert 1 <= saved[0].count() <= 2 and saved[0].agg(F.sum("n")).first()[0] == df.count()
