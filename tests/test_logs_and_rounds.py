import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.operators import clean, graph, metrics, rounds, training
from reviewlake.sources.shardlog import ShardLog, ShardLogError


def test_log_goes_on_and_refuses_other_configurations(spark, tmp_path):
    work = spark.createDataFrame([(f"u{n % 20}", n) for n in range(100)], "user_id string, n long")
    path, config, seen = f"{tmp_path}/log", {"k": [5, 10]}, []

    def evaluate(part):
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("stopped")
        return part.select("user_id", "n", (F.col("n") * 2).alias("value"))

    with pytest.raises(RuntimeError, match="stopped"):
        ShardLog(spark, path, config, 4).run(work, "user_id", evaluate)
    log = ShardLog(spark, path, config, 4)
    assert len(log.commits()) == 1 and len(log.pending()) == 3
    # What an interrupted task left of a shard is not read, and written over.
    work.limit(3).select("user_id", "n", F.lit(-1).cast("long").alias("value")).write.parquet(f"{path}/rows/{log.pending()[0]}")
    assert log.read().where("value < 0").count() == 0
    assert log.run(work, "user_id", evaluate) == 3 and len(seen) == 5 and log.run(work, "user_id", evaluate) == 0
    rows = log.read().collect()
    assert sorted((r.n, r.value) for r in rows) == [(n, 2 * n) for n in range(100)]
    assert {n for n, _ in log.commits().values()} and sum(n for n, _ in log.commits().values()) == 100
    for other, shards in (({"k": [5]}, 4), (config, 5)):
        with pytest.raises(ShardLogError):
            ShardLog(spark, path, other, shards)
    fresh = ShardLog(spark, path, {"k": [5]}, 4, resume=False)
    assert not fresh.commits()
    with pytest.raises(ShardLogError):
        fresh.read()
    spark.createDataFrame([(0, 1, "x")], "shard int, n_rows long, digest string").write.parquet(f"{tmp_path}/bare/commits")
    with pytest.raises(ShardLogError, match="no configuration"):
        ShardLog(spark, f"{tmp_path}/bare", config)


def test_rounds_of_verdicts(spark):
    """Row n needs n repairs; row 5 fails at once, row 6 in its second round."""
    rows = spark.createDataFrame([(n,) for n in range(7)], "id int")
    asked = Counter()

    def answer(r):
        asked["answer"] += r.count()
        return r.select("id", F.col("id").alias("left"), F.lit("first").alias("by"), F.when(F.col("id") == 5, "down").alias("error"))

    def repair(r):
        asked["repair"] += r.count()
        return r.select("id", (F.col("left") - F.col("hint")).alias("left"), F.lit("repair").alias("by"), F.when(F.col("id") == 6, "late").alias("error"))

    judge = lambda a: a.select("id", (F.col("left") <= 0).alias("approved"), F.when(F.col("left") > 0, 1).alias("hint"))
    fallback = lambda r: r.select("id", F.lit(-1).alias("left"), F.lit("fallback").alias("by"), F.lit(None).cast("string").alias("error"))
    results, states = rounds.run_rounds(rows, "id", answer, judge, repair, fallback, budget=3)
    last = {r.id: (r.rounds, r.state, r.error) for r in rounds.last_states(states, "id").collect()}
    assert last == {0: (1, "approved", None), 1: (2, "approved", None), 2: (3, "approved", None), 3: (3, "exhausted", None), 4: (3, "exhausted", None), 5: (1, "fallback", "down"), 6: (2, "fallback", "late")}
    assert {r.id: (r.left, r.by) for r in results.collect()} == {0: (0, "first"), 1: (0, "repair"), 2: (0, "repair"), 3: (1, "repair"), 4: (2, "repair"), 5: (-1, "fallback"), 6: (-1, "fallback")}
    assert asked == {"answer": 7, "repair": 5 + 3}
    none, states = rounds.run_rounds(rows.limit(0), "id", answer, judge, repair, fallback)
    assert none.count() == 0 and states.count() == 0


def test_hybrid_extraction(spark):
    triple = "array<struct<aspect string, confidence double>>"
    texts = {1: "sure", 2: "unsure", 3: "nothing", 4: "gap", 5: "down", 6: "repair down"}
    found = {1: [("a", 0.9)], 2: [("b", 0.6)], 3: [], 4: [("c", 0.9)], 5: [("d", 0.9), ("e", 0.1)], 6: []}
    reviews = spark.createDataFrame(list(texts.items()), "review_id int, text string")
    table = spark.createDataFrame(list(found.items()), f"review_id int, triples {triple}")
    saw = {}

    def validate(r):
        saw.update({x.review_id: x.text for x in r.collect()})
        mine = F.when(F.col("review_id") == 1, F.col("candidates")).otherwise(F.array().cast(triple))
        return r.select("review_id", F.when(F.col("review_id") == 2, F.col("candidates")).otherwise(mine).alias("triples"), (F.col("review_id") == 4).alias("needs_repair"), F.when(F.col("review_id") == 4, "x, y").alias("missing"), F.when(F.col("review_id") == 5, "timeout").alias("error"))

    def repair(r):
        saw["hints"] = {x.review_id: x.hint for x in r.collect()}
        return r.select("review_id", F.array(F.struct(F.concat(F.lit("r"), "hint").alias("aspect"), F.lit(0.8).alias("confidence"))).alias("triples"), F.when(F.col("review_id") == 6, "timeout").alias("error"))

    triples, states = rounds.extraction_rounds(reviews, lambda r: table, validate, repair)
    got = {r.review_id: [t.aspect for t in r.triples] for r in triples.collect()}
    assert got == {1: ["a"], 2: ["b"], 3: ["r"], 4: ["rx, y"], 5: ["d"], 6: []}
    assert saw["hints"] == {3: "", 4: "x, y", 6: ""} and saw[1] is None and saw[2] == "unsure" and saw[4] is None
    assert {r.review_id: r.state for r in rounds.last_states(states, "review_id").collect()} == {1: "approved", 2: "approved", 3: "approved", 4: "approved", 5: "fallback", 6: "fallback"}


def test_adjacency_of_hot_and_missing_nodes(spark, tmp_path):
    edges = [(2, n, float(n % 10)) for n in range(1, 200)] + [(4, 1, 0.5), (4, 2, 0.5)]
    df = spark.createDataFrame(edges, "node long, other long, weight double").repartition(7)
    got = {r.node: r for r in graph.padded_adjacency(df, 5, 4).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5]
    assert (got[2].neighbours, got[2].weights, got[2].mask, got[2].degree, got[2].cut, got[2].start) == ([9, 19, 29, 39], [9.0] * 4, [1] * 4, 4, 195, 0)
    assert (got[4].neighbours, got[4].mask, got[4].start, got[4].cut) == ([1, 2, 0, 0], [1, 1, 0, 0], 4, 0) and got[5].start == 6
    assert all(got[n].neighbours == [0] * 4 and got[n].degree == 0 for n in (0, 1, 3, 5))
    assert graph.padded_adjacency(df.limit(0), 2, 3).select("mask").distinct().count() == 1


def test_graph_is_built_saved_and_read(spark, tmp_path):
    from reviewlake.operators import signals
    from reviewlake.plans import graphs

    rows = spark.createDataFrame([(f"u{n % 4}", f"i{n % 5}", f"a{n % 3}", 1.0 - n % 3, 1, 1_700_000_000_000_000 + n * 86_400_000_000, n) for n in range(30)], "user_id string, item string, aspect string, polarity double, helpful int, ts long, row_id long")
    vocabulary = spark.createDataFrame([("a0", 0), ("other", 1)], "aspect string, id int")
    gammas = graph.preference_edges(rows, 1_800_000_000_000_000)
    saved = graphs.build_and_save(rows, signals.item_sentiment(rows), gammas, vocabulary, f"{tmp_path}/graph", 2)
    again = graphs.load(spark, f"{tmp_path}/graph")
    for a, b in zip(saved, again):
        assert a.count() == b.count() > 0
    assert again.nodes.count() == 4 + 5 + 2 and again.item_aspects.count() == 6 and again.aspect_items.count() == 3
    # a1 and a2 count as other.
    assert {x for r in again.item_aspects.where("degree > 0").collect() for x in r.neighbours if x} == {1, 2}


def test_batches_do_not_depend_on_partitions_and_negatives_are_unseen(spark):
    r = random.Random(4)
    rows = [(f"u{r.randrange(12)}", f"i{r.randrange(30)}", n * 1000, n) for n in range(260)] + [("one", "i1", 1, 900)] + [("all", f"i{n}", n, 1000 + n) for n in range(30)]
    df = spark.createDataFrame(rows, "user_id string, item string, ts long, row_id long")
    ids = clean.id_maps(df)
    local = {x.id: x.local for x in ids.collect()}
    made = [sorted(map(tuple, training.training_batches(df.repartition(n), ids, 6, 5, epoch=e).collect())) for n, e in ((1, 0), (9, 0), (9, 1))]
    assert made[0] == made[1] != made[2] and [x[2] for x in made[0]] != [x[2] for x in made[2]]
    history = defaultdict(list)
    for u, i, ts, n in sorted(rows, key=lambda x: (x[2], x[1], x[3])):
        history[u].append(local[i])
    assert {x[2] for x in made[0]} == {u for u in history if len(history[u]) > 1}
    assert [(x[0], x[1]) for x in made[0]] == [(n // 5, n % 5) for n in range(13)]
    for _, _, u, seq, times, positive, negative in made[0]:
        own = history[u]
        want = own[:-1][-6:]
        assert seq == [0] * (6 - len(want)) + want and positive == [0] * (6 - len(want)) + own[1:][-6:]
        assert all((n == 0) == (p == 0 or u == "all") and n not in own for n, p in zip(negative, positive)) and max(negative) <= 30
        assert times == sorted(times)


def test_bootstrap_sums_are_bounded_and_exact(spark, monkeypatch):
    n = 3000
    df = spark.createDataFrame([(f"u{i}", float(i % 17)) for i in range(n)] + [("none", None)], "unit string, value double").repartition(8)
    rows = df.where("value is not null").selectExpr("cast(conv(substring(md5(concat('42:', unit)), 1, 8), 16, 10) as long) k", "value").collect()
    keys, values = np.array([r.k for r in rows]), np.array([r.value for r in rows])
    counts = metrics.poisson_counts(keys, 400)
    assert abs(counts.mean() - 1) < 0.01 and abs(counts.var() - 1) < 0.02 and np.abs(np.corrcoef(counts.T)[0, 1:]).max() < 0.08
    want = np.sort(values @ counts / counts.sum(0))
    for rows in (2048, 7):
        monkeypatch.setattr(metrics, "DRAWN", rows)
        got = metrics.bootstrap_ci(df, 400).first()
        assert np.allclose([got.low, got.high], [want[10], want[390]]) and abs(got.mean - values.mean()) < 1e-12
    assert abs(want.std() / (values.std() / n**0.5) - 1) < 0.15
    empty = metrics.bootstrap_ci(df.limit(0), 10).first()
    assert empty.mean is None and empty.low is None


def test_metric_table(spark):
    rows = [("u", "hr", 5, 1.0), ("u", "hr", 5, 0.0), ("v", "hr", 5, 1.0), ("v", "mrr", 5, 0.5)]
    got = {(r.metric, r.user_id): (r.n, r["mean"], r.n_users, r.user_mean) for r in metrics.metric_table(spark.createDataFrame(rows, "user_id string, metric string, k int, value double")).collect()}
    assert got == {("hr", "u"): (2, 0.5, None, None), ("hr", "v"): (1, 1.0, None, None), ("hr", None): (3, 2 / 3, 2, 0.75), ("mrr", "v"): (1, 0.5, None, None), ("mrr", None): (1, 0.5, 1, 0.5)}
