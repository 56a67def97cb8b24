import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.functions import columns as C
from reviewlake.operators import clean, covisit, features, graph, metrics, quality, ranking, sequence, signals, text
from reviewlake.operators.inference import extract_triples, form_batches, repair_rounds, rerank, validated
from reviewlake.plans import recommend

DAY = C.DAY_US
ROW = "user_id string, item string, ts long, rating double, helpful_vote int, verified boolean, row_id long"


def rows(spark, *items):
    return spark.createDataFrame([(u, i, t, r, 0, True, n) for n, (u, i, t, r) in enumerate(items)], ROW)


def listed(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def in_order(df):
    return [r.item for r in df.orderBy("user_id", "rank").collect()]


def pool(spark, *items, **more):
    return spark.createDataFrame([("u", i, n + 1) for n, i in enumerate(items)], "user_id string, item string, rank int")


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# ---------------------------------------------------------------- cleaning
def test_dedup(spark):
    got = clean.dedup_earliest(rows(spark, ("u1", "i1", 200, 4.0), ("u1", "i1", 100, 2.0), ("u1", "i2", 150, 3.0)))
    assert listed(got, "user_id", "item", "ts", "rating") == [("u1", "i1", 100, 2.0), ("u1", "i2", 150, 3.0)]


@pytest.mark.parametrize(("extra", "k", "left"), [([("u4", "i3")], 2, 6), ([], 3, 6), ([], 4, 0)])
def test_k_core(spark, extra, k, left):
    block = [(f"u{u}", f"i{i}") for u in range(3) for i in range(2 if k == 2 else 3)][: 6 if k == 2 else 9] + extra
    got = clean.k_core(rows(spark, *((u, i, 1, 1.0) for u, i in block)), k)
    assert got.count() == (left if k != 3 else 9)
    summary = clean.k_core_summary(got).first()
    assert summary.n_rows == got.count() and (left == 0) == (summary.n_users == 0)


def test_splits(spark):
    ten = rows(spark, *(("u1", f"i{i}", i * 10, 1.0) for i in range(10)), *(("u2", f"i{i}", i, 1.0) for i in range(5)))
    got = {(r.user_id, r.item): r.split for r in clean.chronological_split(ten).collect()}
    assert [got["u1", f"i{i}"] for i in range(10)] == ["train"] * 8 + ["valid", "test"]
    assert {got["u2", f"i{i}"] for i in range(5)} == {"train"}
    assert clean.chronological_split(ten, min_history=9).where("split <> 'train'").count() == 0
    with pytest.raises(ValueError, match="sum to 1.0"):
        clean.chronological_split(ten, 0.8, 0.1, 0.2)
    four = clean.leave_last_out(rows(spark, *(("u", f"i{i}", i * 10, 1.0) for i in (1, 2, 3, 4)), ("v", "i1", 1, 1.0), ("v", "i2", 2, 1.0)))
    assert listed(four, "user_id", "item", "split") == [("u", "i1", "train"), ("u", "i2", "train"), ("u", "i3", "valid"), ("u", "i4", "test"), ("v", "i1", "train"), ("v", "i2", "train")]
    m = {r.split: r for r in clean.split_manifest(four).collect()}
    assert m["train"].n_rows == 4 and m["test"].pct_verified == 100.0


def test_scope_and_targets(spark):
    train = rows(spark, ("u1", "i1", 100, 1.0), ("u2", "i2", 200, 1.0))
    made = [("r_in", "u1", "i1", 100, "good", 1), ("r_late", "u1", "i1", 999, "late", 2), ("r_out", "u9", "i1", 1, "out", 3), ("r_dup", "u2", "i2", 150, "a", 4), ("r_dup", "u2", "i2", 150, "b", 5), ("r_blank", "u1", "i2", 5, " ", 6)]
    reviews = spark.createDataFrame(made, "review_id string, user_id string, item string, ts long, text string, row_id long")
    targets, counters = clean.export_targets(reviews, train)
    assert listed(targets, "review_id", "text") == [("r_dup", "a"), ("r_in", "good")]
    c = counters.first()
    assert (c.scanned, c.in_scope, c.blank, c.written, c.duplicates) == (6, 4, 1, 2, 1)
    assert listed(clean.review_index(reviews, train), "review_id") == [("r_blank",), ("r_dup",), ("r_in",)]


def test_id_maps(spark):
    got = clean.id_maps(rows(spark, *(("u", f"i{i:03d}", 1, 1.0) for i in range(300)), ("u", "i000", 2, 1.0)))
    assert listed(got, "local", "id") == [(i + 1, f"i{i:03d}") for i in range(300)]


# ---------------------------------------------------------------- signals
SIGNAL = "user_id string, item string, aspect string, polarity double, helpful int, ts long, row_id long"


def test_weights(spark):
    now = 100 * DAY
    g = spark.createDataFrame([("u", "i", "scent", 1.0, 0, now - 90 * DAY, 1), ("u", "i", "comfort", -1.0, 0, now - DAY, 2), ("u", "i", "late", 1.0, 0, now, 3), ("n", "i", "scent", 0.0, 0, 1, 4)], SIGNAL)
    q = spark.createDataFrame([("u", now), ("n", now)], "user_id string, query_ts long")
    w = {(r.user_id, r.aspect): r.weight for r in signals.decayed_weights(g, q, 0.05).collect()}
    assert set(w) == {("u", "scent"), ("u", "comfort")} and w["u", "comfort"] > w["u", "scent"] and abs(sum(w.values()) - 1) < 1e-12
    gamma = {r.aspect: r.gamma for r in signals.interest_scores(g, q, 0.02).where("user_id = 'u'").collect()}
    assert gamma["scent"] > 0 > gamma["comfort"]


def test_item_sentiment(spark):
    g = spark.createDataFrame([("u", "i", "a", 1.0, 1000, 1, 1), ("u", "i", "a", -1.0, 0, 1, 2)], SIGNAL)
    r = signals.item_sentiment(g, 10).first()
    assert abs(r.score - 10 / 12) < 1e-12 and abs(r.e_hat - 0.9166666) < 1e-6 and r.n_support == 2 and r.plain == 0.0


def test_s_ui_and_strong(spark):
    base = spark.createDataFrame([("u", "i1", 0.7), ("u", "i2", 0.8)], "user_id string, item string, s_base double")
    w = spark.createDataFrame([("u", "a", 1.0)], "user_id string, aspect string, weight double")
    e = spark.createDataFrame([("i1", "a", 0.9, 5), ("i3", "a", 0.1, 5)], "item string, aspect string, e_hat double, n_support int")
    total = lambda alpha: {r.item: round(r.total, 9) for r in signals.s_ui(base, w, e, alpha).collect()}
    assert total(1.0)["i1"] == 0.7 and total(0.0)["i1"] == 0.9 and total(0.5)["i2"] == 0.4
    assert listed(signals.strong_items(e, w, 5), "item") == [("i1",)]


def test_faithfulness(spark):
    scored = spark.createDataFrame([("u", "i1", 0.20, 0.71), ("u", "i2", 0.40, 0.40)], "user_id string, item string, base_part double, total double")
    parts = spark.createDataFrame([("u", "i1", "a", 0.50), ("u", "i1", "b", 0.01)], "user_id string, item string, aspect string, part double")
    r = signals.faithfulness(scored, parts, scored.where("item = 'i1'").select("user_id", "item"), parts.where("aspect = 'a'").select("user_id", "aspect")).first()
    assert (r.rank_drop, round(r.comprehensiveness, 9), round(r.sufficiency_gap, 9), r.faithful) == (1, 0.5, 0.01, True)


def test_shift_and_probe(spark):
    g = spark.createDataFrame([("u1", "i", "scent", 1.0, 0, 1, 1), ("u1", "i", "comfort", -0.9, 0, 2, 2), ("u2", "i", "scent", 1.0, 0, 1, 3), ("u2", "i", "comfort", 0.9, 0, 2, 4), ("u3", "i", "comfort", 1.0, 0, 1, 5), ("u3", "i", "comfort", -1.0, 0, 2, 6), ("u4", "i", "x", -1.0, 0, 1, 7)], SIGNAL)
    assert listed(signals.shift_users(g), "user_id", "aspect") == [("u1", "comfort")]
    base = spark.createDataFrame([("u1", "i1", 0.3), ("u1", "i2", 0.4)], "user_id string, item string, s_base double")
    e = spark.createDataFrame([("i1", "scent", 0.9, 3), ("i2", "scent", 0.1, 3), ("i2", "comfort", 0.9, 3)], "item string, aspect string, e_hat double, n_support int")
    q = spark.createDataFrame([("u1", 10)], "user_id string, query_ts long")
    r = signals.counterfactual_probe(g.where("aspect = 'scent'"), q, base, e, q.select("user_id", F.lit("comfort").alias("aspect"))).first()
    assert (r.item, r.rank_before, r.rank_after, r.moved_up) == ("i2", 2, 1, True)


# ---------------------------------------------------------------- sequences and co-visits
TOY = [("u1", "a1", 1 * DAY, 1.0), ("u1", "a2", 2 * DAY, 1.0), ("u2", "a1", 1 * DAY, 1.0), ("u2", "b1", 3 * DAY, 1.0), ("u3", "a1", 1 * DAY, 1.0), ("u3", "b1", 2 * DAY, 1.0)]


def test_sequence(spark):
    t = rows(spark, *TOY)
    assert listed(sequence.transitions(t), "prev", "next", "n") == [("a1", "a2", 1), ("a1", "b1", 2)]
    p = {r.next: r.p for r in sequence.markov_probabilities(t).collect()}
    assert abs(p["b1"] - 2 / 3) < 1e-12
    cand = spark.createDataFrame([("u1", "a1"), ("new", "a1"), ("new", "zz")], "user_id string, item string")
    assert listed(sequence.next_item_scores(cand, t), "user_id", "item", "score") == [("new", "a1", 3.0), ("new", "zz", 0.0), ("u1", "a1", 3.0)]
    scale = {r.user_id: r.scale for r in sequence.time_scale(rows(spark, ("u", "a", 0, 1.0), ("u", "b", 2000, 1.0), ("u", "c", 5000, 1.0), ("v", "a", 3, 1.0))).collect()}
    assert scale == {"u": 2000, "v": 1}
    assert listed(sequence.normalized_events(rows(spark, ("u", "a", 0, 1.0), ("u", "b", 2, 1.0), ("u", "c", 5, 1.0))), "item", "norm_ts") == [("a", 1), ("b", 2), ("c", 3)]
    ids = clean.id_maps(t)
    assert sequence.user_sequences(t, ids).count() == 3
    bucket = lambda a, b: one(spark, sequence.time_bucket(F.lit(a), F.lit(b)).alias("x")).x
    assert (bucket(10, 10), bucket(0, 500), bucket(500, 0)) == (120, 239, 0)
    r = one(spark, sequence.padded(F.array(*(F.lit(i).cast("long") for i in (1, 2, 3))), 5).alias("a"), sequence.padded(F.array(*(F.lit(i).cast("long") for i in (1, 2, 3))), 2, False).alias("b"), sequence.time_matrix(F.array(F.lit(0), F.lit(900)), 256).alias("m"))
    assert r.a == [0, 0, 1, 2, 3] and r.b == [2, 3] and r.m == [[0, 256], [256, 0]]


def test_asof(spark):
    q = spark.createDataFrame([("u", 10), ("u", 0), ("w", 5)], "user_id string, query_ts long")
    x = spark.createDataFrame([("u", 1, "one"), ("u", 9, "nine"), ("u", 11, "later")], "user_id string, ts long, text string")
    assert {(r.user_id, r.query_ts): r.text for r in sequence.asof_text(q, x).collect()} == {("u", 10): "nine", ("u", 0): "one", ("w", 5): None}


def test_covisits(spark):
    t = rows(spark, ("u1", "A", 1, 1.0), ("u1", "X", 2, 1.0), ("u1", "Y", 3, 1.0))
    wrote = spark.createDataFrame([("u1", "A", "text"), ("u1", "X", " ")], "user_id string, item string, text string")
    assert listed(covisit.covisit_edges(t, wrote), "anchor", "co", "n") == [("A", "X", 1), ("A", "Y", 1)]
    assert covisit.covisit_edges(t).count() == 6
    edges = spark.createDataFrame([("A", "X", 4), ("A", "Y", 2)], "anchor string, co string, n long")
    got = covisit.coitem_scores(spark.createDataFrame([("u", "A")], "user_id string, item string"), spark.createDataFrame([("u", i) for i in "XYZ"], "user_id string, item string"), edges)
    assert listed(got, "item", "score") == [("X", 1.0), ("Y", 0.5)]
    sim = {(r.anchor, r.co): r.similarity for r in covisit.item_similarity(rows(spark, *TOY)).collect()}
    assert sim["a1", "a1"] == 1.0 and abs(sim["a1", "b1"] - 2 / math.sqrt(6)) < 1e-12


# ---------------------------------------------------------------- lists
def test_merges(spark):
    p = pool(spark, *"abcde")
    assert in_order(ranking.merge_ranking(pool(spark, "b", "a"), p, 2)) == list("bacde")
    assert in_order(ranking.promote_then_fill(pool(spark, *"abcd"), pool(spark, *"cdx"), 2)) == list("cdab")
    twelve = [f"i{n}" for n in range(1, 13)]
    got = in_order(ranking.promote_swap(pool(spark, *twelve), pool(spark, "i12", "i11"), 1, 9))
    assert got == [*twelve[:9], "i12", "i10", "i11"]
    assert in_order(ranking.promote_after_head(p, pool(spark, "e", "a", "d"), 1, 2)) == list("abecd")
    assert in_order(ranking.reorder_head(p, pool(spark, "c", "b"), 3)) == list("cbade")
    assert in_order(ranking.blend_ranks(p, pool(spark, *"edcba"), 1.0)) == list("edcba") and in_order(ranking.blend_ranks(p, pool(spark, *"edcba"), 0.0)) == list("abcde")
    assert [r.ok for r in ranking.guardrail(p, pool(spark, *"bcdeya"), 1, 5).collect()] == [False]
    assert in_order(ranking.union_by_priority([pool(spark, "x", "a"), p], 4, pool(spark, "b"))) == ["x", "a", "c", "d"]
    r = one(spark, ranking.coerce_ranking(F.array(*map(F.lit, "bbzc")), F.array(*map(F.lit, "abcd"))).alias("x"))
    assert r.x == list("bcad")


def test_popular_unseen(spark):
    t = rows(spark, *TOY)
    users = spark.createDataFrame([("u1",), ("u9",)], "user_id string")
    got = ranking.popular_unseen(t, users, 2)
    assert [(r.user_id, r.item) for r in got.orderBy("user_id", "rank").collect()] == [("u1", "b1"), ("u9", "a1"), ("u9", "b1")]
    tests = t.where("row_id in (1, 3)").select("row_id", "user_id", "item")
    neg = ranking.sampled_negatives(tests, t, t.where("row_id < 0"), 2)
    assert {r.row_id: r["count"] for r in neg.groupBy("row_id").count().collect()} == {1: 3, 3: 3}


def test_probe_takes_scores_alike_to_nine_digits_as_equal(spark):
    g = spark.createDataFrame([("u", "comfort", 1.0, 0)], "user_id string, aspect string, polarity double, ts long")
    q = spark.createDataFrame([("u", 10)], "user_id string, query_ts long")
    base = spark.createDataFrame([("u", "a", 0.5), ("u", "b", 0.5 + 1e-12)], "user_id string, item string, s_base double")
    e = spark.createDataFrame([("b", "fit", 0.5)], "item string, aspect string, e_hat double")
    r = signals.counterfactual_probe(g, q, base, e, q.select("user_id", F.lit("comfort").alias("aspect"))).first()
    assert (r.item, r.rank_before, r.rank_after, r.moved_up) == ("b", 2, 2, False)


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", i, n + 1) for n, i in enumerate("abxcd")], "user_id string, item string, rank int")

    def at(k, *relevant):
        return metrics.rank_metrics(ranked, spark.createDataFrame([("q", i) for i in relevant], "user_id string, item string"), (k,)).first()

    assert at(2, "x").hr_2 == 0.0 and at(3, "x").hr_3 == 1.0
    assert at(2, "a", "x").recall_2 == 0.5 and at(3, "a", "x").recall_3 == 1.0
    assert at(3, "x").ndcg_3 == 0.5 and abs(at(5, "a", "x").ndcg_5 - 1.5 / (1 + 1 / math.log2(3))) < 1e-12
    assert abs(at(5, "x").mrr_5 - 1 / 3) < 1e-12 and at(2, "x").mrr_2 == 0.0 and at(5, "a", "x").mrr_5 == 1.0
    with pytest.raises(ValueError):
        at(0, "x")


def test_significance(spark):
    a = spark.createDataFrame([(i, 1.0) for i in range(30)], "unit int, value double")
    zero, up = a.withColumn("value", F.lit(0.0)), metrics.paired_bootstrap
    r, same = up(a, zero, 200).first(), up(a, a, 200).first()
    assert r.delta == 1.0 and r.p_value < 0.05 and same.p_value == 1.0
    ci = metrics.bootstrap_ci(a.withColumn("value", F.col("unit") / 10), 300).first()
    assert ci.low < ci.mean < ci.high
    p = spark.range(1).select(metrics.t_tail(F.lit(2.0), F.lit(11)).alias("a"), metrics.t_tail(F.lit(0.0), F.lit(5)).alias("b"), metrics.t_tail(F.lit(1.96), F.lit(10**7)).alias("c"), metrics.t_tail(F.lit(12.706), F.lit(2)).alias("d")).first()
    assert abs(p.a - 0.0734) < 2e-4 and p.b == 1.0 and abs(p.c - 0.05) < 1e-4 and abs(p.d - 0.05) < 1e-4


def test_potential(spark):
    z = features.with_zscores(spark.createDataFrame([("u", "a", 1.0), ("u", "b", 3.0), ("v", "c", 2.0), ("v", "d", 2.0)], "user_id string, item string, seq double"), ("seq",))
    assert {r.item: r.z_seq for r in z.collect()} == {"a": -1.0, "b": 1.0, "c": 0.0, "d": 0.0}
    assert [one(spark, features.rank_penalty(F.lit(r)).alias("x")).x for r in (1, 20, 30)] == [1.0, 0.05, 0.0]
    gates = [one(spark, features.gate(F.lit(c), F.lit(m)).alias("x")).x for c, m in ((0.6, 0.5), (0.2, 0.5), (0.6, 0.95))]
    assert gates == ["ok", "low_c_u", "high_stage1_margin"]
    phi = spark.createDataFrame([("u", f"i{n}", n, 5.0 if n == 25 else 0.0) for n in range(1, 31)], "user_id string, item string, rank int, phi double")
    got = features.greedy_swaps(phi).where("item = 'i25'").first()
    assert got["rank"] == 20


def test_quality(spark):
    t = lambda *x: spark.createDataFrame([(*r, 1.0) for r in x], "review_id int, aspect string, sentiment string, confidence double")
    same = quality.matches(t((1, "smell", "positive")), t((1, " Scent", "positive")))
    assert quality.micro(same).first().f1 == 1.0
    flip = quality.matches(t((1, "scent", "negative")), t((1, "scent", "positive")))
    assert quality.error_summary(flip).first().sentiment_flip == 1
    half = quality.matches(t((1, "scent", "positive"), (2, "x", "positive")), t((1, "scent", "positive"), (2, "y", "positive")))
    assert quality.macro_review(half).first().f1 == 0.5
    vocab = quality.aspect_vocabulary(t(*[(i, "scent", "positive") for i in range(6)], *[(i, "comfort", "positive") for i in range(4)], (9, "rare", "positive")), 2, 1)
    assert listed(vocab, "id", "aspect") == [(0, "OTHER"), (1, "scent"), (2, "comfort")]
    assert listed(quality.with_aspect_id(t((1, "rare", "x"), (2, "smell", "x")), vocab), "review_id", "aspect_id") == [(1, 0), (2, 1)]
    s = quality.stratified_sample(spark.createDataFrame([(i, i % 5 + 1.0, "w " * (i + 1)) for i in range(40)], "review_id int, rating double, text string"), 12)
    assert s.count() == 12 and s.select("stratum").distinct().count() >= 6


def test_graph(spark):
    g = spark.createDataFrame([("u1", "i1", "a", 1.0, 0, 0, 1), ("u2", "i2", "b", -1.0, 0, 3 * DAY, 2)], SIGNAL)
    e = graph.edges(g, signals.item_sentiment(g), graph.preference_edges(g, 5 * DAY))
    assert e.count() == 12 and e.where("bucket < 0 or bucket > 239").count() == 0
    nodes = graph.nodes(g, spark.createDataFrame([(0, "OTHER", 0), (1, "a", 1)], "id int, aspect string, n long"))
    assert listed(nodes, "id", "key") == [(0, "u1"), (1, "u2"), (2, "i1"), (3, "i2"), (4, "OTHER"), (5, "a")]


# ---------------------------------------------------------------- text, models
def test_text(spark):
    r = one(spark, text.card(F.lit("A"), F.lit("Soft cream"), F.lit("Skin, Face, Body, More"), F.lit(0.5)).alias("card"), text.preference_tokens(F.lit("The BEST serum, a serum for dry-skin!")).alias("t"), C.cut(F.lit("abcdefgh"), 5).alias("cut"))
    assert r.card == "A | S=0.5000 | name=Soft cream | cats=Skin, Face, Body" and sorted(r.t) == ["best", "dry-skin", "serum"] and r.cut == "abcd…"
    raw = '```json\n{"ranked_item_ids": ["b", "zz", "a'
    pool_ = F.array(*map(F.lit, "abc"))
    found = one(spark, text.ranked_ids(F.lit(raw), pool_).alias("x"), text.partial_triples(F.lit('{"triples": [{"aspect": "Scent", "opinion": "nice", "sentiment": "Positive", "confidence": "90%"}, {"aspect": "x')).alias("t"))
    assert found.x == ["b", "a", "c"] and [(t.aspect, t.sentiment, t.confidence) for t in found.t] == [("scent", "positive", 0.9)]
    made = spark.createDataFrame([(1, 'Sure: {“a”: [1, 2,], "b": "x"} ok'), (2, '{"a": 1, "b": [2, {"c": "cut'), (3, "none"), (4, None), (5, '{"a": 1, "b"')], "id int, raw string")
    got = {r.id: r.json for r in text.tolerant_json(made, "raw").collect()}
    assert got == {1: '{"a": [1, 2], "b": "x"}', 2: '{"a": 1, "b": [2, {"c": "cut"}]}', 3: None, 4: None, 5: '{"a": 1}'}
    mentions = spark.createDataFrame([("u", "B00A"), ("u", "B00B1"), ("u", "B0")], "user_id string, mention string")
    assert listed(text.resolve_prefix(mentions, spark.createDataFrame([("u", "B00A1"), ("u", "B00A2"), ("u", "B00B1"), ("u", "B00B12")], "user_id string, item string")), "mention", "item") == [("B00B1", "B00B1")]
    v = one(spark, text.hash_vector(F.lit("soft soft cream"), 16).alias("v")).v
    assert abs(sum(x * x for x in v.values()) - 1) < 1e-9


def test_models(spark):
    reviews = spark.createDataFrame([(1, "good scent and bad fit"), (2, " "), (3, "fail here"), (4, "cached")], "review_id int, text string")

    def picky(texts):
        if any("fail" in t for t in texts):
            raise RuntimeError("no")
        from reviewlake.operators.inference import lexicon_extractor

        return lexicon_extractor(texts)

    got = {r.review_id: r for r in extract_triples(reviews, picky, reviews.where("review_id = 4")).collect()}
    assert set(got) == {1, 3} and len(got[1].triples) == 2 and got[3].error == "RuntimeError: no"
    assert validated(extract_triples(reviews), 0.9).where("size(triples) > 0").count() == 0
    p = pool(spark, *"abc").withColumn("query", F.lit("q"))
    assert in_order(rerank(p, lambda q, items: ["c", "zz", "a"])) == ["c", "a", "b"] and in_order(rerank(p, lambda q, items: 1 / 0)) == ["a", "b", "c"]
    jobs = spark.createDataFrame([("u", 1, 300)] * 3 + [("u", 2, 300)] * 3, "user_id string, ts long, cost int")
    sizes = [r["count"] for r in form_batches(jobs, 4, 700).groupBy("batch").count().collect()]
    assert sum(sizes) == 6 and max(sizes) == 2
    assert in_order(repair_rounds(pool(spark, *"abc"), lambda r: r.where("item = 'b'"))) == ["a", "c"]


def test_second_stage(spark):
    from reviewlake.operators import rerank as R
    from reviewlake.plans.rerank import second_stage

    stage1 = spark.createDataFrame([(u, f"i{n}", n, 1.0 / n) for u in "uv" for n in range(1, 16)], "user_id string, item string, rank int, score double")
    meta = spark.createDataFrame([(f"i{n}", "gentle night serum" if n == 12 else "plain thing", "x") for n in range(1, 16)], "item string, name string, categories string")
    texts = spark.createDataFrame([("u", "a gentle serum for the night"), ("v", " ")], "user_id string, text string")
    got = second_stage(stage1, stage1.limit(0).select("user_id", "item", "score"), texts, meta, pool_k=15)
    lists = {u: [r.item for r in got.where(F.col("user_id") == u).orderBy("rank").collect()] for u in "uv"}
    plain = [f"i{n}" for n in range(1, 16)]
    assert lists["v"] == plain and lists["u"] == [*plain[:9], "i12", "i10", "i11", "i13", "i14", "i15"]
    cards = spark.createDataFrame([("u", "a", 1, 9, 6, True, "x"), ("u", "b", 2, 7, 6, True, "x"), ("u", "c", 3, 9, 1, False, "x"), ("u", "d", 4, 9, 1, True, " "), ("u", "e", 5, 8, 6, True, "y")], "user_id string, item string, place int, fit int, displacee_fit int, beats_displacee boolean, evidence string")
    assert in_order(R.scorecard_picks(cards, 2)) == ["a", "e"]
    cases = spark.createDataFrame([("u", 1), ("v", 1), ("w", 1)], "user_id string, query_ts long")
    kept = spark.createDataFrame([("u", 1, "text", True), ("v", 1, " ", True), ("w", 1, "text", False)], "user_id string, ts long, text string, has_reviews boolean")
    assert listed(R.eligible(cases, kept), "user_id") == [("u",)] and R.eligible(cases, kept, True).count() == 3
    assert one(spark, R.token_budget(F.array(F.lit(10), F.lit(20))).alias("x")).x == 604


def test_plans(spark):
    data = rows(spark, *((f"u{u}", f"i{(u * 7 + i * (u % 3 + 1)) % 12}", i * DAY + u, 1.0) for u in range(12) for i in range(12)))
    split = recommend.build_dataset(data, k=2, min_history=1)
    train, test = clean.part(split, "train"), clean.part(split, "test")
    for name, scorer in recommend.scorers(train).items():
        if name not in ("svd", "base_cf"):
            m = recommend.evaluate(scorer, train, test, (5,))
            assert m.count() == test.select("user_id").distinct().count()
    assert recommend.evaluate_sampled(recommend.scorers(train)["popularity"], train, test, 3, (1, 3)).count() == test.count()


def plain_swaps(order, phi, head_n, focus_k, tau, gamma, most):
    order, n = list(order), min(head_n, len(order))
    focus = sorted(order, key=lambda x: (-phi[x], order.index(x)))[:focus_k]
    for _ in range(most):
        gains = [(phi[c] - phi[d] - tau * (n + 1 - (order.index(d) + 1)) / n, c, d) for c in focus if c not in order[:n] for d in order[:n]]
        best = max(gains, key=lambda g: g[0], default=None)
        if best is None or best[0] <= gamma:
            break
        i, j = order.index(best[1]), order.index(best[2])
        order[i], order[j] = order[j], order[i]
    return order


@pytest.mark.parametrize(("size", "head_n", "focus_k", "most"), [(60, 20, 50, 10), (60, 5, 8, 10), (12, 20, 50, 10), (30, 10, 40, 2)])
def test_swaps_take_their_focus_by_phi(spark, size, head_n, focus_k, most):
    rng = random.Random(size + head_n)
    pools = {u: [f"i{k}" for k in range(size)] for u in ("a", "b")}
    phi = {u: {x: round(rng.random() * 2, 2) for x in items} for u, items in pools.items()}
    phi["a"][f"i{size - 1}"] = 9.0  # the best comes last
    df = spark.createDataFrame([(u, x, k + 1, phi[u][x]) for u, items in pools.items() for k, x in enumerate(items)], "user_id string, item string, rank int, phi double")
    got = {u: [r.item for r in features.greedy_swaps(df, head_n, focus_k, 0.25, 0.0, most).where(F.col("user_id") == u).orderBy("rank").collect()] for u in pools}
    assert got == {u: plain_swaps(items, phi[u], head_n, focus_k, 0.25, 0.0, most) for u, items in pools.items()}
    assert size <= head_n or got["a"].index(f"i{size - 1}") < head_n


def test_paired_tests_take_the_same_units(spark):
    make = lambda *v: spark.createDataFrame([(f"u{i}", float(x)) for i, x in enumerate(v)], "unit string, value double")
    for test in (metrics.paired_ttest, metrics.paired_bootstrap):
        for a, b in ((make(1, 2, 3), make(1, 2)), (make(1, 2), make(1, 2, 3)), (make(1), make(2))):
            with pytest.raises(Exception, match="paired"):
                test(a, b).collect()
    r = metrics.paired_ttest(make(1, 2, 3, 5), make(0, 2, 2, 3)).first()
    assert r.n == 4 and abs(r.t - 1.0 / (r.sd / 2)) < 1e-9 and abs(r.p_value - 0.0917) < 1e-3
    assert metrics.paired_ttest(make(2, 3, 4), make(1, 2, 3)).first().p_value == 0.0


def test_negatives_are_complete(spark):
    items = spark.createDataFrame([(f"i{k}",) for k in range(40)], "item string")
    seen = spark.createDataFrame([("u", f"i{k}") for k in range(30)], "user_id string, item string")
    tests = spark.createDataFrame([(1, "u", "i39"), (2, "v", "i0")], "row_id long, user_id string, item string")
    got = ranking.sampled_negatives(tests, items, seen, 25).collect()
    assert sorted(r.item for r in got if r.row_id == 1 and not r.relevant) == sorted(f"i{k}" for k in range(30, 39))
    assert len({r.item for r in got if r.row_id == 2 and not r.relevant} - {"i0"}) == 25


def test_negatives_do_not_depend_on_how_seen_items_are_met(spark, monkeypatch):
    items = spark.createDataFrame([(f"i{k}",) for k in range(60)], "item string")
    seen = spark.createDataFrame([(u, f"i{k}") for u, n in (("u", 30), ("v", 3), ("w", 55)) for k in range(n)], "user_id string, item string")
    tests = spark.createDataFrame([(k, u, f"i{k % 50}") for k, u in enumerate("uvwxuvwx")], "row_id long, user_id string, item string")
    got = []
    for most in (4096, 10, 0):  # all users' seen items as arrays, some users', none
        monkeypatch.setattr(ranking, "SEEN", most)
        got.append(sorted(map(tuple, ranking.sampled_negatives(tests, items, seen, 10).collect())))
    assert got[0] == got[1] == got[2]
    rows_of = {k: {r[2] for r in got[0] if r[0] == k and not r[3]} for k in range(8)}
    assert {k: len(x) for k, x in rows_of.items()} == {k: 5 if k in (2, 6) else 10 for k in range(8)}
    assert not any(x & {f"i{j}" for j in range(30)} for k, x in rows_of.items() if k in (0, 4))


def test_small_helpers(spark, tmp_path):
    assert metrics.effective_ks((5, 10), (1, 5), 100) == (1, 5, 10) and metrics.effective_ks((5, 10), (1,)) == (5, 10)
    rows = spark.createDataFrame([(x,) for x in (5, 1, 9, 3, None)], "x int")
    assert metrics.upper_median(rows, "x").first().median == 5
    cards = spark.createDataFrame([("u", "a", "A", 3), ("v", "b", "B", None)], "user_id string, item string, card string, hits int")
    low = spark.createDataFrame([("u", "x", 1), ("u", "y", 2)], "user_id string, item string, hits int")
    assert {r.card for r in text.with_overlap(cards, low).collect()} == {"A | ov=3/2", "B"}
    w = np.arange(21.0)
    features.save_listwise(spark, str(tmp_path / "m"), w, w + 1, w + 2)
    got = features.load_listwise(spark, str(tmp_path / "m"))
    assert got[3] == features.LTR_FEATURES and all((a == b).all() for a, b in zip(got[:3], (w, w + 1, w + 2)))


def test_batches_keep_a_users_moment_together(spark):
    rng = random.Random(2)
    made = [(f"u{rng.randint(0, 5)}", rng.randint(0, 9), rng.randint(1, 60)) for _ in range(200)]
    df = spark.createDataFrame(made, "user_id string, ts long, cost long")
    got = form_batches(df, 6, 150, lanes=2).collect()
    assert sorted((r.user_id, r.ts, r.cost) for r in got) == sorted(made)
    groups, batches = {}, {}
    for r in got:
        groups.setdefault((r.user_id, r.ts), []).append(r)
        batches.setdefault(r.batch, []).append(r.cost)
    assert all(len(b) <= 6 and (sum(b) <= 150 or len(b) == 1) for b in batches.values())
    for g in groups.values():
        if len(g) <= 6 and sum(r.cost for r in g) <= 150:
            assert len({r.batch for r in g}) == 1


def test_users_with_many_items_meet_in_blocks(spark, monkeypatch):
    rows = [("hot", f"i{n:02}") for n in range(40)] + [("a", "i01"), ("a", "i02"), ("b", "i02"), ("b", "i02"), ("c", None)]
    df = spark.createDataFrame(rows, "user_id string, item string")
    want = {}
    for u in {u for u, _ in rows}:
        own = {i for v, i in rows if v == u and i}
        for x in own:
            for y in own - {x}:
                want[x, y] = want.get((x, y), 0) + 1
    for block in (3, 7, 2000):
        got = {(r["anchor"], r["co"]): r["n"] for r in covisit._pairs(df, df, block).collect()}
        assert got == want


def test_vector_topk_in_blocks_equals_all_pairs(spark):
    import random

    r = random.Random(5)
    vec = lambda: [r.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)]
    items = [(f"i{n:02}", vec()) for n in range(50)] + [("none", None), ("zero", [0.0] * 4)]
    users = [(n, vec()) for n in range(9)] + [(9, None)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b)) if a and b else 0.0
    v, q = spark.createDataFrame(items, "item string, vector array<double>").repartition(3), spark.createDataFrame(users, "user_id int, query array<double>")
    for metric in ("dot", "cosine"):
        def score(a, b, metric=metric):
            scale = (dot(a, a) * dot(b, b)) ** 0.5 if metric == "cosine" else 1.0
            return round(dot(a, b) / scale, 9) if scale else 0.0
        want = {(u, i) for u, x in users for i, _ in sorted(items, key=lambda t: (-score(x, t[1]), t[0]))[:6]}
        got = ranking.vector_topk(q, v, 6, metric, block=7).collect()
        assert {(x["user_id"], x["item"]) for x in got} == want
    assert ranking.vector_topk(q.limit(0), v, 3).count() == 0 and ranking.vector_topk(q, v.limit(0), 3).count() == 0


def test_places_among_unseen_items(spark):
    import random

    from reviewlake.operators import protocol

    r = random.Random(3)
    train = [(n, f"u{r.randrange(6)}", f"i{r.randrange(20)}", r.randrange(50)) for n in range(60)]
    tests = [(100 + n, f"u{r.randrange(7)}", f"i{r.randrange(24)}", 60 + r.randrange(5)) for n in range(30)]
    scores = {f"i{n}": float(n % 4) for n in range(20)}
    schema = "row_id long, user_id string, item string, ts long"
    tr, te, sc = spark.createDataFrame(train, schema), spark.createDataFrame(tests, schema), spark.createDataFrame(list(scores.items()), "item string, score double")
    for cumulative in (False, True):
        want = {}
        for row, u, i, ts in tests:
            seen = {x[2] for x in train if x[1] == u} | ({x[2] for x in tests if x[1] == u and x[3] < ts} if cumulative else set())
            order = sorted((x for x in scores if x not in seen or x == i), key=lambda x: (-scores[x], x))
            want[row] = order.index(i) + 1 if i in scores else len(order) + 1
        assert {x["row_id"]: x["rank"] for x in protocol.unseen_places(te, sc, tr, cumulative).collect()} == want


def test_protocol_helpers(spark):
    from reviewlake.operators import protocol

    assert protocol.effective_ks([10, 5], [1, 10], True) == [1, 5, 10] and protocol.effective_ks([10, 5], [1]) == [10, 5]
    schema = "row_id long, user_id string, item string, ts long"
    a = spark.createDataFrame([(1, "u", "x", 1), (2, "u", "y", 5)], schema)
    b = spark.createDataFrame([(3, "u", "z", 3), (4, "u", "z", 7), (5, "v", "x", 1)], schema)
    assert {(r["row_id"], *r["history"]) for r in protocol.event_cases(a, b).collect()} == {(3, "x"), (4, "x", "z", "y")}
    assert {(r["row_id"], *r["history"]) for r in protocol.event_cases(a, b, 1).collect()} == {(3, "x"), (4, "y")}
    some = [r["row_id"] for r in protocol.sampled_cases(b, 2).collect()]
    assert len(some) == 2 and some == [r["row_id"] for r in protocol.sampled_cases(b.repartition(3), 2).collect()]
    assert protocol.sampled_cases(b, None).count() == 3
    none = spark.createDataFrame([], "calls long, repaired boolean, fast boolean")
    assert tuple(protocol.call_rates(none).first()) == (0, 0, 0, 0, 0.0, 0.0, 0.0)
    empty = protocol.row_metrics(spark.createDataFrame([], "row_id long, rank long"), (5,), "full").collect()
    assert {(r["metric"], r["k"], r["value"]) for r in empty} == {("hr", 5, 0.0), ("ndcg", 5, 0.0), ("mrr", 5, 0.0)}


def test_explanations_cite_drivers_and_known_facts_only(spark):
    from reviewlake.operators import explain

    parts = spark.createDataFrame([("u", "i", a, p) for a, p in (("a", 0.1), ("b", 0.3), ("c", 0.2), ("d", 0.05))], "user_id string, item string, aspect string, part double")
    weights = spark.createDataFrame([("u", "b", 0.6)], "user_id string, aspect string, weight double")
    sentiment = spark.createDataFrame([("i", "b", 0.9, 4), ("i", "c", 0.2, 1)], "item string, aspect string, e_hat double, n_support long")
    said = spark.createDataFrame([("u", "b", 1.0, 1, 1), ("u", "b", -1.0, 2, 2)], "user_id string, aspect string, polarity double, ts long, row_id long")
    specs = spark.createDataFrame([("i", "weight", None), ("i", "price", "9.5")], "item string, key string, value string")
    r = explain.explanations(parts, weights, sentiment, said, 3, specs).first()
    assert [e["aspect"] for e in r["evidence"]] == ["b", "c", "a"] and r["evidence"][2]["n_support"] == 0
    assert r["claims"][0] == "you previously expressed negative sentiment about b; This item rates positively on b (Ê=0.90, 4 supporting reviews, contribution 0.300)"
    assert r["claims"][-1] == "price: 9.5" and len(r["claims"]) == 4
    assert r["summary"] == "Recommended i because it aligns with your priorities on b, c, a (top driver contribution: 0.300)."


def test_window_mode_moves_the_window_and_keeps_lists_without_text(spark):
    from reviewlake.plans import rerank

    stage1 = spark.createDataFrame([(u, f"i{n}", n, 1.0 - n / 100) for u in ("u", "w") for n in range(1, 9)], "user_id string, item string, rank int, score double")
    boosts = spark.createDataFrame([], "user_id string, item string, score double")
    phi = spark.createDataFrame([("u", f"i{n}", float(n)) for n in range(1, 9)], "user_id string, item string, phi double")
    texts = spark.createDataFrame([("u", "anything at all"), ("w", " ")], "user_id string, text string")
    meta = spark.createDataFrame([("i1", "lamp", "home", 1.0)], "item string, name string, categories string, price double")
    lists = lambda df: {u: [r["item"] for r in sorted(df.where(f"user_id = '{u}'").collect(), key=lambda r: r["rank"])] for u in ("u", "w")}
    out = lists(rerank.context_stage(stage1, boosts, phi, texts, meta, {"phi": 1.0}, pool_k=6, cap=2))
    assert out == {"u": ["i6", "i5", "i1", "i2", "i3", "i4", "i7", "i8"], "w": [f"i{n}" for n in range(1, 9)]}
    strict = lists(rerank.context_stage(stage1, boosts, phi, texts, meta, {"phi": 1.0}, pool_k=6, cap=2, max_drop=3))
    assert strict["u"] == [f"i{n}" for n in range(1, 9)]


def test_rows_of_one_row_id_count_together(spark, tmp_path):
    from reviewlake.operators import protocol
    from reviewlake.plans.queries import ORACLE_SQL, QUERIES

    from .compare import connect, difference

    schema = "row_id long, user_id string, item string, ts long"
    train = spark.createDataFrame([(1, "u", "a", 1), (2, "u", "c", 2), (3, "v", "b", 1), (4, "v", "c", 1)], schema)
    tests = spark.createDataFrame([(9, "u", "b", 5), (9, "u", "e", 5), (9, "v", "d", 5), (8, "u", "d", 6)], schema)
    order = spark.createDataFrame([(i, -float(n)) for n, i in enumerate("abcde")], "item string, score double")
    alone, together = ({(r.row_id, r.user_id, r.item): r["rank"] for r in protocol.unseen_places(tests, order, train, together=x).collect()} for x in (None, protocol.ahead_together(tests, order, train)))
    assert alone == {(9, "u", "b"): 1, (9, "u", "e"): 3, (9, "v", "d"): 2, (8, "u", "d"): 2}
    assert together == {(9, "u", "b"): -1, (9, "u", "e"): 2, (9, "v", "d"): 1, (8, "u", "d"): 2}  # a, b and c are ahead of one of the three
    # Lines of an order that agree in number, supplier and price share a row_id.
    d = "/root/testdata/sf0.001"
    con = connect(d)
    con.sql(f"COPY (SELECT * REPLACE (1 AS l_linenumber, 0 AS l_suppkey, 1000.0 AS l_extendedprice) FROM lineitem) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.sql(f"COPY orders TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    assert difference(spark, connect(str(tmp_path)), str(tmp_path), QUERIES["resumed_evaluation"], ORACLE_SQL["resumed_evaluation"]) is None


def test_few_items_do_not_put_all_queries_into_one_task(spark):
    q = spark.createDataFrame([(u, [float(u), 1.0]) for u in range(60)], "user_id int, query array<double>").repartition(3)
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "item string, vector array<double>")
    found = ranking.vector_topk(q, v, None, "dot", block=5)
    assert found.count() == 120
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().toString()  # not merged into one for the blocks' small size
