import random

import pytest
from pyspark.sql import functions as F

from reviewlake.operators import catalogue


def world(spark, seed, users=7, items=25):
    r = random.Random(seed)
    u, i = [f"u{n}" for n in range(users)], [f"i{n}" for n in range(items)]
    hits = {(r.choice(u), r.choice(i)): float(r.randrange(-2, 5)) for _ in range(40)}
    orders = {"plain": {x: 0.0 for x in i}, "pop": {x: float(r.randrange(4)) for x in i}}
    bases = {x: "pop" for x in u if r.random() < 0.5}
    seen = {(r.choice(u), r.choice(i)) for _ in range(40)}
    gold = {(r.choice([*u, "new"]), r.choice([*i, "unknown", "other"])) for _ in range(30)}
    model = catalogue.SparseScores(
        spark.createDataFrame([(*k, v) for k, v in hits.items()], "user_id string, item string, score double"),
        spark.createDataFrame([(b, x, v) for b, o in orders.items() for x, v in o.items()], "base string, item string, score double"),
        spark.createDataFrame(list(bases.items()) or [], "user_id string, base string"),
    )
    return hits, orders, bases, seen, gold, model


def full_list(user, hits, orders, bases, out, extra=()):
    scores = dict(orders[bases.get(user, "plain")])
    scores |= {x: 0.0 for x in extra if x not in scores}
    scores |= {i: s for (u, i), s in hits.items() if u == user}
    return sorted(((i, s) for i, s in scores.items() if i not in out), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_best_and_places_like_the_whole_matrix(spark, seed):
    hits, orders, bases, seen, gold, model = world(spark, seed)
    pairs = lambda x: spark.createDataFrame(sorted(x), "user_id string, item string")
    users = spark.createDataFrame([(f"u{n}",) for n in range(7)] + [("new",), ("new",)], "user_id string")
    for k, out in ((1, None), (5, seen), (40, seen)):
        got = {}
        for r in catalogue.best(model, users, k, pairs(out) if out else None).collect():
            got.setdefault(r.user_id, []).append((r["rank"], r.item, r.score))
        for u in [f"u{n}" for n in range(7)] + ["new"]:
            want = full_list(u, hits, orders, bases, {i for x, i in out or () if x == u})[:k]
            assert [x[1:] for x in sorted(got.get(u, []))] == want
    for out in (set(), seen):
        places = {(r.user_id, r.item): (r.score, r["rank"]) for r in catalogue.gold_places(model, pairs(gold), pairs(out) if out else None).collect()}
        assert set(places) == gold
        for u in {u for u, _ in gold}:
            own = {i for x, i in gold if x == u}
            order = full_list(u, hits, orders, bases, {i for x, i in out if x == u} - own, own)
            assert all(places[u, i] == (s, n) for n, (i, s) in enumerate(order, 1) if i in own)
    lists = catalogue.best(catalogue.with_gold(model, pairs(gold)), pairs(gold).select("user_id"), 30, None)
    assert lists.where("item in ('unknown', 'other')").count() == sum(i in ("unknown", "other") for _, i in gold)


def test_sums_of_hot_groups_over_ranges(spark):
    rows = [("hot", n * 7919 % 5000, 1) for n in range(5000)] + [(f"g{n}", 1, 5) for n in range(50)]
    df = spark.createDataFrame(rows, "g string, n int, v int").repartition(9)
    got = catalogue.running_sums(df, ["g"], ["n"], "v", "total").collect()
    assert len(got) == 5050 and all(r.total == (r.n + 1 if r.g == "hot" else 5) for r in got)


def test_empty_tables_and_plan_without_products(spark):
    *_, model = world(spark, 4)
    none = spark.createDataFrame([], "user_id string, item string")
    assert catalogue.best(model, none, 3, none).count() == 0 and catalogue.gold_places(model, none, none).count() == 0
    users = spark.createDataFrame([("u1", "i1"), ("u2", "zz")], "user_id string, item string")
    empty = catalogue.SparseScores(model.hits.limit(0), model.orders.limit(0))
    assert catalogue.best(empty, users, 3).count() == 0
    assert {(r.item, r["rank"]) for r in catalogue.gold_places(empty, users).collect()} == {("i1", 1), ("zz", 1)}
    for df in (catalogue.best(model, users, 3, users), catalogue.gold_places(model, users, users.withColumn("item", F.lit("i3")))):
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("cumulative", [False, True])
def test_places_of_rows_under_a_model(spark, cumulative):
    from reviewlake.operators import protocol

    hits, orders, bases, seen, _, model = world(spark, 5)
    r = random.Random(6)
    tests = [(n, f"u{r.randrange(7)}", r.choice([f"i{r.randrange(25)}", "unknown"]), r.randrange(4)) for n in range(40)]
    schema = "row_id long, user_id string, item string, ts long"
    train = spark.createDataFrame([(0, u, i, 0) for u, i in seen], schema)
    got = {x.row_id: x["rank"] for x in protocol.model_places(spark.createDataFrame(tests, schema), model, train, cumulative).collect()}
    for row, u, i, ts in tests:
        out = {x for v, x in seen if v == u} | ({x[2] for x in tests if x[1] == u and x[3] < ts} if cumulative else set())
        order = [x for x, _ in full_list(u, hits, orders, bases, out - {i})]
        assert got[row] == (order.index(i) + 1 if i in order else len(order) + 1)


def test_evaluations_of_models(spark):
    from reviewlake.operators import metrics
    from reviewlake.plans import recommend

    r = random.Random(8)
    rows = [(n, f"u{r.randrange(6)}", f"i{r.randrange(15)}", n) for n in range(120)]
    schema = "row_id long, user_id string, item string, ts long"
    train, test = spark.createDataFrame(rows[:90], schema), spark.createDataFrame(rows[90:], schema)
    found, plain = recommend.models(train), recommend.scorers(train)
    for name in ("popularity", "itemknn", "sequential", "markov"):
        a, b, c = (sorted(map(tuple, recommend.evaluate(m, train, test, (3, 5), block_users=n).select("user_id", "hr_3", "recall_5", "mrr_5").collect())) for m, n in ((found[name], 9), (plain[name], 100), (plain[name], 2)))
        assert a == b == c
    assert recommend.evaluate(found["markov"], train, test, (3,), most_users=2).count() == 2
    wide = recommend.evaluate_rows(train, test, found["sequential"], [5], [1], 4, cumulative=True)
    assert {(x["pass"], x.metric) for x in wide.collect()} == {(p, m) for p in ("full", "sampled") for m in ("hr", "ndcg", "mrr")}
    assert metrics.rank_metrics(catalogue.best(found["markov"], test, 5), test, (5,)).count() == test.select("user_id").distinct().count()


def test_evaluation_of_factors(spark):
    from reviewlake.operators import factors
    from reviewlake.plans import recommend

    r = random.Random(9)
    rows = [(n, f"u{r.randrange(6)}", f"i{r.randrange(15)}", n) for n in range(100)] + [(100, "new", "i3", 1), (101, "u1", "unknown", 1)]
    schema = "row_id long, user_id string, item string, ts long"
    train, test = spark.createDataFrame(rows[:80], schema), spark.createDataFrame(rows[80:], schema)
    model = factors.truncated_svd(train, 4)
    a, b = (sorted(map(tuple, recommend.evaluate(m, train, test, (3, 5)).select("user_id", "hr_3", "recall_5", "mrr_5").collect())) for m in (model, lambda c: factors.factor_scores(c, model).withColumn("score", F.round("score", 9))))
    assert a == b and len(a) == 7


@pytest.mark.parametrize("name", ["next_item_scores", "markov_scores", "itemknn_scores", "adjusted_scores"])
def test_every_user_has_every_item(spark, name):
    from reviewlake.plans import tables as T
    from reviewlake.plans.queries import QUERIES

    d = "/root/testdata/sf0.001"
    g = T.signals(spark, d)
    n_items = g.select("item").distinct().count()
    got = QUERIES[name](spark, d).groupBy("user_id").agg(F.count_distinct("item").alias("n"), F.max("rank").alias("last"))
    assert got.where(f"n <> {n_items} or last <> {n_items}").isEmpty() and got.count() == g.select("user_id").distinct().count()


def test_lists_beyond_the_near_places(spark, monkeypatch):
    orders = spark.createDataFrame([("plain", f"i{k:02}", float(-(k // 3))) for k in range(30)], "base string, item string, score double")
    hits = spark.createDataFrame([("u", "i20", 5.0), ("u", "i01", -9.0)], "user_id string, item string, score double")
    out = spark.createDataFrame([("u", f"i{k:02}") for k in range(8)] * 2 + [("v", "i00")], "user_id string, item string")
    users = spark.createDataFrame([("u",), ("v",)], "user_id string")
    model, found = catalogue.SparseScores(hits, orders), []
    for near in (10_000, 4, 0):
        monkeypatch.setattr(catalogue, "NEAR", near)
        found.append(sorted((r.user_id, r["rank"], r.item) for r in catalogue.best(model, users, 3, out).collect()))
    assert found[0] == found[1] == found[2] == [("u", 1, "i20"), ("u", 2, "i08"), ("u", 3, "i09"), ("v", 1, "i01"), ("v", 2, "i02"), ("v", 3, "i03")]
    assert catalogue.best(model, users, None, out).count() == 22 + 29
