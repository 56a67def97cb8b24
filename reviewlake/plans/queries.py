"""Queries over the driver's tables, one per operator or small group of them, each with SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.session import save, shared_dir
from ..operators import boosting, catalogue, clean, covisit, explain, factors, features, graph, metrics, protocol, quality, ranking, rounds, sequence, signals, text, training
from . import recommend
from . import tables as T

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

# ------------------------------------------------------------------ SQL that the queries share
I = """i AS (SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS item, 1 + floor((l_quantity - 1) / 10) AS rating, epoch_us(o_orderdate) AS ts,
  CAST(round(l_tax * 100) AS INT) AS helpful_vote, l_returnflag <> 'R' AS verified, (l_orderkey * 8 + l_linenumber) * 1000000 + l_suppkey % 1000 * 1000 + CAST(round(l_extendedprice * 100) AS BIGINT) % 1000 AS row_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""  # noqa: E741
D = I + ", d AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY user_id, item ORDER BY ts, row_id) = 1)"
P = D + ", p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item, row_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM d)"
S = (
    P
    + """, s0 AS (SELECT *, floor(n * 0.8::DOUBLE) AS nt, floor(n * 0.1::DOUBLE) AS nv FROM p), s AS (SELECT *, CASE WHEN nt < 5 OR nt < 1 OR nv < 1 OR n - nt - nv < 1 OR pos <= nt THEN 'train'
  WHEN pos <= nt + nv THEN 'valid' ELSE 'test' END AS split FROM s0), tr AS (SELECT * FROM s WHERE split = 'train'), te AS (SELECT * FROM s WHERE split = 'test')"""
)
G = """g AS (SELECT CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS item, 'a' || CAST(event_id % 8 AS VARCHAR) AS aspect,
  CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.5 WHEN 'signup' THEN 0.25 WHEN 'error' THEN -1.0 ELSE 0.0 END::DOUBLE AS polarity,
  CAST(floor(value) AS INT) AS helpful, epoch_us(ts) AS ts, event_id AS row_id FROM events)"""
Q = str(T.QUERY_TS)
INTEREST = G + f""", it AS (SELECT user_id, aspect, sum(abs(polarity) * exp(-0.01 * ({Q} - ts) / 86400000000.0::DOUBLE)) AS interest, sum(polarity * abs(polarity) * exp(-0.01 * ({Q} - ts) / 86400000000.0::DOUBLE)) AS gamma
  FROM g WHERE ts < {Q} GROUP BY 1, 2), w AS (SELECT user_id, aspect, interest / total AS weight FROM (SELECT *, sum(interest) OVER (PARTITION BY user_id) AS total FROM it) WHERE total > 0)"""
SENT = """e AS (SELECT item, aspect, sum((1 + least(greatest(helpful, 0), 10)) * polarity) / sum(1 + least(greatest(helpful, 0), 10)) AS score, count(*) AS n_support, avg(polarity) AS plain FROM g GROUP BY 1, 2),
  eh AS (SELECT *, greatest(0, least(1, (score + 1) / 2)) AS e_hat FROM e)"""
GI = "SELECT DISTINCT user_id, item FROM g"
#: Pools of the list queries: a user's items by number of signals, and by their last signal.
POOL = """pool AS (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, item) AS rank, n, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, item) AS r2
  FROM (SELECT user_id, item, count(*) AS n, max(ts) AS last FROM g GROUP BY 1, 2))"""
M = "m AS (SELECT CAST(p_partkey AS VARCHAR) AS item, p_name AS name, p_type || ', ' || p_brand AS categories, p_retailprice AS price FROM part)"
TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9][a-z0-9\\-\\+]{{1,}}'))"


def triples_sql(shift: int) -> str:
    return f"""SELECT l_orderkey AS review_id, lower(trim(['smell', 'Scent ', 'price', 'fit', 'packaging', 'texture', 'colour', 'size'][CAST((l_partkey + {shift} * (l_linenumber % 3)) % 8 + 1 AS INT)])) AS raw,
      ['positive', 'negative', 'neutral'][CAST((l_suppkey + {shift} * (l_linenumber % 2)) % 3 + 1 AS INT)] AS sentiment, 0.4::DOUBLE + l_discount * 5 AS confidence FROM lineitem"""


NORM = "CASE raw WHEN 'smell' THEN 'scent' WHEN 'price' THEN 'value' WHEN 'fit' THEN 'comfort' WHEN 'texture' THEN 'feel' ELSE raw END AS aspect"
TG = f"tp AS (SELECT review_id, {NORM}, sentiment, confidence FROM ({triples_sql(0)})), tg AS (SELECT review_id, {NORM}, sentiment, confidence FROM ({triples_sql(1)}))"
MATCH = TG + """, mt AS (SELECT coalesce(a.review_id, b.review_id) AS review_id, coalesce(a.aspect, b.aspect) AS aspect, coalesce(a.sentiment, b.sentiment) AS sentiment, a.review_id IS NOT NULL AS p, b.review_id IS NOT NULL AS g
  FROM (SELECT DISTINCT review_id, aspect, sentiment FROM tp) a FULL JOIN (SELECT DISTINCT review_id, aspect, sentiment FROM tg) b ON a.review_id = b.review_id AND a.aspect = b.aspect AND a.sentiment = b.sentiment)"""
COUNTS = "CAST(count(*) FILTER (WHERE p AND g) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE p AND NOT g) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE g AND NOT p) AS BIGINT) AS fn"
F1 = "round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1"


def query(sql: str | None = None):
    """Registers a query (spark, sf_dir) with the SQL that gives the same rows."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def split_of(spark, d) -> DataFrame:
    # Dealt by user once: the earliest of each pair and a user's order both need no more.
    return clean.chronological_split(clean.dedup_earliest(T.interactions(spark, d).repartition("user_id")), min_history=5)


def pairs_split(spark, d) -> DataFrame:
    """The split with no more than who, what and when."""
    return _pairs_split(T.interactions(spark, d).select("user_id", "item", "ts", "row_id"))


def _pairs_split(rows: DataFrame) -> DataFrame:
    return clean.chronological_split(clean.dedup_earliest(rows.repartition("user_id")), min_history=5)


def signal_pool(spark, d) -> DataFrame:
    n = T.signals(spark, d).groupBy("user_id", "item").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    w = Window.partitionBy("user_id")
    return n.select("user_id", "item", "n", F.row_number().over(w.orderBy(F.desc("n"), "item")).alias("rank"), F.row_number().over(w.orderBy(F.desc("last"), "item")).alias("r2"))


def ranked(df: DataFrame) -> DataFrame:
    return df.select("user_id", "item", F.col("rank").cast("long").alias("rank"))


# ------------------------------------------------------------------ cleaning and splits
@query(f"WITH {D} SELECT user_id, item, rating, ts, helpful_vote, verified, row_id FROM d")
def dedup_earliest(spark, d):
    return clean.dedup_earliest(T.interactions(spark, d))


@query(f"WITH {I} SELECT count(*) AS n, CAST(sum(rating) AS DOUBLE) AS total, min(ts) AS first_ts, max(ts) AS last_ts FROM i WHERE ts BETWEEN 800000000000000 AND 850000000000000")
def in_period(spark, d):
    return clean.in_period(T.interactions(spark, d), 800_000_000_000_000, 850_000_000_000_000).agg(F.count("*").alias("n"), F.sum("rating").alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _core_sql(k: int, rounds: int) -> str:
    out = f"WITH {D}, c0 AS (SELECT user_id, item FROM d)"
    for r in range(rounds):
        out += f", c{r + 1} AS (SELECT * FROM c{r} WHERE user_id IN (SELECT user_id FROM c{r} GROUP BY 1 HAVING count(*) >= {k}) AND item IN (SELECT item FROM c{r} GROUP BY 1 HAVING count(*) >= {k}))"
    return out + f" SELECT user_id, item FROM c{rounds}"


@query(_core_sql(20, 12))
def kcore_20(spark, d):
    return clean.k_core(clean.dedup_earliest(T.interactions(spark, d)).select("user_id", "item"), 20)


@query(f"""WITH {D} SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT item) AS n_items,
  (SELECT min(c) FROM (SELECT count(*) AS c FROM d GROUP BY user_id)) AS min_user_degree, (SELECT min(c) FROM (SELECT count(*) AS c FROM d GROUP BY item)) AS min_item_degree FROM d""")
def kcore_summary(spark, d):
    return clean.k_core_summary(clean.dedup_earliest(T.interactions(spark, d)))


@query(f"WITH {D} SELECT user_id, item FROM d WHERE item IN (SELECT item FROM d GROUP BY 1 ORDER BY count(*) DESC, item LIMIT 300)")
def cap_by_degree(spark, d):
    return clean.cap_by_degree(clean.dedup_earliest(T.interactions(spark, d)), "item", 300, order=F.col("item")).select("user_id", "item")


@query(f"WITH {S} SELECT row_id, user_id, item, split FROM s")
def chronological_split(spark, d):
    return split_of(spark, d).select("row_id", "user_id", "item", "split")


@query(f"WITH {P} SELECT row_id, user_id, item, CASE WHEN n >= 3 AND n - 2 >= 5 AND pos = n THEN 'test' WHEN n >= 3 AND n - 2 >= 5 AND pos = n - 1 THEN 'valid' ELSE 'train' END AS split FROM p")
def leave_last_out(spark, d):
    return clean.leave_last_out(clean.dedup_earliest(T.interactions(spark, d)), 5).select("row_id", "user_id", "item", "split")


@query(f"""WITH {S} SELECT split, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT item) AS n_items, min(ts) AS first_ts, max(ts) AS last_ts,
  round(100 * avg(CASE WHEN verified THEN 1.0::DOUBLE ELSE 0 END), 4) AS pct_verified FROM s GROUP BY 1""")
def split_manifest(spark, d):
    return clean.split_manifest(split_of(spark, d))


@query(f"WITH {S} SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM s WHERE split IN ('train', 'valid')")
def history_scope(spark, d):
    return clean.history_scope(split_of(spark, d), "train_valid").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(f"""WITH {S} SELECT row_id, user_id, item FROM i WHERE user_id IN (SELECT user_id FROM tr) AND item IN (SELECT item FROM tr)
  AND ts <= (SELECT max(ts) FROM tr)""")
def train_scope_semijoin(spark, d):
    rows = save(T.interactions(spark, d).select("user_id", "item", "ts", "row_id"), "interactions")
    train = save(clean.part(_pairs_split(rows), "train").select("user_id", "item", "ts"), "train")  # read three times
    return clean.in_train_scope(rows, train).select("row_id", "user_id", "item")


@query(f"WITH {D} SELECT item AS id, row_number() OVER (ORDER BY item) AS local FROM (SELECT DISTINCT item FROM d)")
def id_maps(spark, d):
    return clean.id_maps(T.interactions(spark, d)).select("id", F.col("local").cast("long").alias("local"))


@query(f"WITH {S} SELECT user_id, count(DISTINCT item) AS n_relevant, max(ts) AS query_ts, count(*) AS n_rows FROM te WHERE verified GROUP BY 1")
def user_cases(spark, d):
    cases = clean.cases_by_user(clean.part(split_of(spark, d), "test"), verified_only=True)
    return cases.select("user_id", F.size("relevant").cast("long").alias("n_relevant"), "query_ts", "n_rows")


# ------------------------------------------------------------------ signals and S(u, i)
@query(f"WITH {INTEREST} SELECT user_id, aspect, round(interest, 6) AS interest, round(gamma, 6) AS gamma FROM it")
def interest_scores(spark, d):
    g = T.signals(spark, d)
    return r6(signals.interest_scores(g, T.queries_at(g)), "interest", "gamma").drop("query_ts")


@query(f"WITH {INTEREST} SELECT user_id, aspect, round(weight, 6) AS weight FROM w")
def decayed_weights(spark, d):
    g = T.signals(spark, d)
    return r6(signals.decayed_weights(g, T.queries_at(g)), "weight").drop("query_ts")


@query(f"WITH {G}, t AS (SELECT user_id, aspect, sum(abs(polarity)) AS x FROM g GROUP BY 1, 2) SELECT user_id, aspect, round(x / total, 6) AS weight FROM (SELECT *, sum(x) OVER (PARTITION BY user_id) AS total FROM t) WHERE total > 0")
def static_weights(spark, d):
    return r6(signals.static_weights(T.signals(spark, d)), "weight")


@query(f"WITH {INTEREST} SELECT user_id, aspect, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, aspect) AS rank FROM w) WHERE rank <= 3")
def top_aspects(spark, d):
    g = T.signals(spark, d)
    return signals.top_aspects(signals.decayed_weights(g, T.queries_at(g)), 3).select("user_id", "aspect", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {G}, {SENT} SELECT item, aspect, round(score, 6) AS score, n_support, round(plain, 6) AS plain, round(e_hat, 6) AS e_hat FROM eh")
def item_sentiment(spark, d):
    return r6(signals.item_sentiment(T.signals(spark, d)), "score", "plain", "e_hat")


@query(f"""WITH {INTEREST}, {SENT}, t AS (SELECT user_id, item, sum(weight * e_hat) AS score FROM w JOIN eh USING (aspect) WHERE n_support >= 3 AND e_hat >= 0.65 GROUP BY 1, 2)
  SELECT user_id, item, round(score, 6) AS score FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item) <= 10""")
def strong_items(spark, d):
    g = T.signals(spark, d)
    wanted = signals.decayed_weights(g, T.queries_at(g))
    found = signals.strong_items(signals.item_sentiment(g), wanted, 100)
    again = ranking.top_k(found.drop("rank").withColumn("s", F.round("score", 9)), 10, ["user_id"], [F.desc("s"), "item"])
    return r6(again, "score").select("user_id", "item", "score")


@query(f"WITH {G} SELECT user_id, aspect, min(ts) AS first_ts FROM g WHERE ts < {Q} AND polarity < -0.3 AND {Q} - ts <= 10 * 86400000000 GROUP BY 1, 2")
def recent_complaints(spark, d):
    g = T.signals(spark, d)
    return signals.recent_complaints(g, T.queries_at(g), days=10)


@query(f"""WITH {G}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, row_id DESC) AS back, count(*) OVER (PARTITION BY user_id) AS n FROM g),
  b AS (SELECT user_id, aspect, sum(abs(polarity)) AS x FROM o WHERE back > 1 GROUP BY 1, 2), bw AS (SELECT user_id, aspect, x / sum(x) OVER (PARTITION BY user_id) AS weight FROM b)
  SELECT o.user_id, o.aspect FROM o LEFT JOIN bw ON o.user_id = bw.user_id AND o.aspect = bw.aspect WHERE back = 1 AND n >= 2 AND polarity <= -0.5 AND coalesce(weight, 0) <= 0.13""")
def shift_users(spark, d):
    return signals.shift_users(T.signals(spark, d), salience=0.13)


_SUI = f"""{INTEREST}, {SENT}, b AS (SELECT user_id, item, count(*) / 10.0::DOUBLE AS s_base FROM g GROUP BY 1, 2),
  su AS (SELECT b.user_id, b.item, 0.5 * s_base AS base_part, 0.5 * coalesce(sum(weight * e_hat), 0) AS affective FROM b LEFT JOIN w ON b.user_id = w.user_id LEFT JOIN eh ON eh.item = b.item AND eh.aspect = w.aspect GROUP BY b.user_id, b.item, s_base)"""


def _sui(spark, d):
    g = T.signals(spark, d)
    base = g.groupBy("user_id", "item").agg((F.count("*") / 10.0).alias("s_base"))
    w, e = signals.decayed_weights(g, T.queries_at(g)), signals.item_sentiment(g)
    return g, base, w, e, signals.s_ui(base, w, e)


@query(f"WITH {_SUI} SELECT user_id, item, round(base_part, 6) AS base_part, round(affective, 6) AS affective, round(base_part + affective, 6) AS total FROM su")
def s_ui(spark, d):
    return r6(_sui(spark, d)[-1], "base_part", "affective", "total").drop("s_base")


@query(f"WITH {_SUI} SELECT user_id, item, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(base_part + affective, 9) DESC, item) AS BIGINT) AS rank FROM su")
def s_ui_rank(spark, d):
    total = _sui(spark, d)[-1].withColumn("score", F.round("total", 9))
    return ranked(ranking.rank_by_score(total))


@query(f"""WITH {_SUI}, c AS (SELECT user_id, aspect FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, aspect) = 1),
  tt AS (SELECT user_id, item, base_part + affective AS total, base_part FROM su QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(base_part + affective, 9) DESC, item) = 1)
  SELECT tt.user_id, tt.item, round(coalesce(0.5 * weight * e_hat, 0), 6) AS comprehensiveness, round(abs(total - base_part - coalesce(0.5 * weight * e_hat, 0)), 6) AS sufficiency_gap
  FROM tt LEFT JOIN c USING (user_id) LEFT JOIN w ON w.user_id = tt.user_id AND w.aspect = c.aspect LEFT JOIN eh ON eh.item = tt.item AND eh.aspect = c.aspect""")
def faithfulness(spark, d):
    _, base, w, e, total = _sui(spark, d)
    targets = ranking.rank_by_score(total.withColumn("score", F.round("total", 9)), 1).select("user_id", "item")
    cited = signals.top_aspects(w, 1).select("user_id", "aspect")
    out = signals.faithfulness(total, signals.contributions(base, w, e), targets, cited)
    return r6(out, "comprehensiveness", "sufficiency_gap").select("user_id", "item", "comprehensiveness", "sufficiency_gap")


@query(f"""WITH {_SUI}, g2 AS (SELECT user_id, aspect, polarity, ts FROM g UNION ALL SELECT DISTINCT user_id, 'a3', -0.9::DOUBLE, {Q} - 1 FROM g),
  it2 AS (SELECT user_id, aspect, sum(abs(polarity) * exp(-0.01 * ({Q} - ts) / 86400000000.0::DOUBLE)) AS interest FROM g2 WHERE ts < {Q} GROUP BY 1, 2), w2 AS (SELECT user_id, aspect, interest / total AS weight FROM (SELECT *, sum(interest) OVER (PARTITION BY user_id) AS total FROM it2) WHERE total > 0),
  su2 AS (SELECT b.user_id, b.item, 0.5 * s_base + 0.5 * coalesce(sum(weight * e_hat), 0) AS total FROM b LEFT JOIN w2 ON b.user_id = w2.user_id LEFT JOIN eh ON eh.item = b.item AND eh.aspect = w2.aspect GROUP BY b.user_id, b.item, s_base),
  tg AS (SELECT b.user_id, b.item FROM b LEFT JOIN eh ON eh.item = b.item AND eh.aspect = 'a3' QUALIFY row_number() OVER (PARTITION BY b.user_id ORDER BY coalesce(e_hat, 0) DESC, b.item DESC) = 1),
  r1 AS (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY round(base_part + affective, 9) DESC, item) AS rank_before FROM su), r2 AS (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY round(total, 9) DESC, item) AS rank_after FROM su2)
  SELECT user_id, item, CAST(rank_before AS INT) AS rank_before, CAST(rank_after AS INT) AS rank_after, rank_after < rank_before AS moved_up FROM tg JOIN r1 USING (user_id, item) JOIN r2 USING (user_id, item)""")
def counterfactual_probe(spark, d):
    g, base, _, e, _ = _sui(spark, d)
    return signals.counterfactual_probe(g, T.queries_at(g), base, e, base.select("user_id").distinct().withColumn("aspect", F.lit("a3")))


@query(f"""WITH {G}, {SENT}, {M}, ok AS (SELECT item FROM eh WHERE aspect = 'a1' AND e_hat >= 0.5 INTERSECT SELECT item FROM eh WHERE aspect = 'a2' AND e_hat >= 0.4)
  SELECT p.user_id, p.item FROM ({GI}) p LEFT JOIN m USING (item) WHERE coalesce(price <= 950, true) AND p.item IN (SELECT item FROM ok) AND (p.user_id, p.item) NOT IN (SELECT (user_id, item) FROM g WHERE polarity = -1)""")
def constraints(spark, d):
    g = T.signals(spark, d)
    pool = g.select("user_id", "item").distinct().join(T.items(spark, d).select("item", "price"), "item", "left")
    bad = g.where("polarity = -1").select("user_id", "item").distinct()
    return signals.passes_constraints(pool, signals.item_sentiment(g), bad, {"a1": 0.5, "a2": 0.4}, 950.0).select("user_id", "item")


@query(f"""WITH {G}, {SENT}, c AS (SELECT DISTINCT user_id, aspect FROM g WHERE ts < {Q} AND polarity < -0.3 AND {Q} - ts <= 30 * 86400000000), {M}, r AS (SELECT DISTINCT user_id, item, price FROM ({GI}) LEFT JOIN m USING (item))
  SELECT user_id, item, 'budget' AS violation FROM r WHERE price > 950 UNION ALL SELECT r.user_id, r.item, 'complaint_aspect:' || c.aspect FROM r JOIN c USING (user_id) LEFT JOIN eh ON eh.item = r.item AND eh.aspect = c.aspect WHERE coalesce(e_hat, 0.5) < 0.4""")
def reflection(spark, d):
    g = T.signals(spark, d)
    pool = g.select("user_id", "item").distinct().join(T.items(spark, d).select("item", "price"), "item", "left").withColumn("price_percentile", F.lit(0.5))
    return signals.reflection(pool, signals.recent_complaints(g, T.queries_at(g)), signals.item_sentiment(g), 950.0)


# ------------------------------------------------------------------ sequences
NEXT = "nx AS (SELECT user_id, item AS prev, lead(item) OVER (PARTITION BY user_id ORDER BY ts, item, row_id) AS next FROM g)"


@query(f"WITH {G}, {NEXT} SELECT prev, next, count(*) AS n FROM nx WHERE next IS NOT NULL GROUP BY 1, 2")
def transitions(spark, d):
    return sequence.transitions(T.signals(spark, d))


@query(f"WITH {G}, {NEXT}, t AS (SELECT prev, next, count(*) AS n FROM nx WHERE next IS NOT NULL AND prev <> next GROUP BY 1, 2) SELECT prev, next, round(n / (sum(n) OVER (PARTITION BY prev))::DOUBLE, 6) AS p FROM t")
def markov_probabilities(spark, d):
    return r6(sequence.markov_probabilities(T.signals(spark, d)), "p")


_HALF = "c AS (SELECT u.user_id, v.item FROM (SELECT DISTINCT user_id FROM g) u, (SELECT DISTINCT item FROM g) v)"


def _whole(g: DataFrame, name: str) -> DataFrame:
    """Every item of the whole catalogue for each user under a model, to 9 digits."""
    m = recommend.models(g)[name]
    return r6(catalogue.best(m._replace(hits=m.hits.withColumn("score", F.round("score", 9))), g, None).withColumn("rank", F.col("rank").cast("long")), "score")


def _whole_sql(scores: str) -> str:
    return f" SELECT user_id, item, round(score, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item) AS rank FROM ({scores})"


#: Each model's score of every item of a catalogue {c}, from the rows of a table {g}.
NEXT_SQL = """SELECT c.user_id, c.item, CASE WHEN l.prev IN (SELECT prev FROM t) THEN coalesce(t.n, 0) ELSE (SELECT count(*) FROM g WHERE g.item = c.item) END::DOUBLE AS score FROM c LEFT JOIN l USING (user_id) LEFT JOIN t ON t.prev = l.prev AND t.item = c.item"""
MARKOV_SQL = """SELECT c.user_id, c.item, round(coalesce((SELECT sum(wt * p) FROM rc JOIN pr USING (prev) WHERE rc.user_id = c.user_id AND pr.item = c.item) / (SELECT sum(wt) FROM rc WHERE rc.user_id = c.user_id), 0), 9) AS score FROM c"""
KNN_SQL = """SELECT c.user_id, c.item, round(coalesce((SELECT sum(s) FROM u JOIN sim ON sim.anchor = u.item WHERE u.user_id = c.user_id AND sim.co = c.item), 0), 9) AS score FROM c"""
NEXT_WITH = f"""{NEXT}, t AS (SELECT prev, next AS item, count(*) AS n FROM nx WHERE next IS NOT NULL GROUP BY 1, 2), l AS (SELECT user_id, item AS prev FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item DESC, row_id DESC) = 1)"""
MARKOV_WITH = """tm AS (SELECT prev, next, count(*) AS n FROM nx WHERE next IS NOT NULL AND prev <> next GROUP BY 1, 2), pr AS (SELECT prev, next AS item, n / (sum(n) OVER (PARTITION BY prev))::DOUBLE AS p FROM tm),
  rc AS (SELECT user_id, item AS prev, pow(0.6::DOUBLE, age - 1) AS wt FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item DESC, row_id DESC) AS age FROM g) WHERE age <= 3 AND item IN (SELECT prev FROM pr))"""


@query(f"WITH {G}, {NEXT_WITH}, {_HALF}" + _whole_sql(NEXT_SQL))
def next_item_scores(spark, d):
    return _whole(T.signals(spark, d), "sequential")


@query(f"WITH {G}, {NEXT}, {MARKOV_WITH}, {_HALF}" + _whole_sql(MARKOV_SQL))
def markov_scores(spark, d):
    return _whole(T.signals(spark, d), "markov")


GAPS = "gp AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, item, row_id) AS gap, min(ts) OVER (PARTITION BY user_id) AS first FROM g), sc AS (SELECT user_id, coalesce(min(gap) FILTER (WHERE gap > 0), 1) AS scale FROM gp GROUP BY 1)"


@query(f"WITH {G}, {GAPS} SELECT user_id, scale FROM sc")
def time_scale(spark, d):
    return sequence.time_scale(T.signals(spark, d))


@query(f"WITH {G}, {GAPS} SELECT row_id, user_id, item, CAST(round_even((ts - first) / scale::DOUBLE, 0) AS BIGINT) + 1 AS norm_ts FROM gp JOIN sc USING (user_id)")
def normalized_events(spark, d):
    return sequence.normalized_events(T.signals(spark, d)).select("row_id", "user_id", "item", "norm_ts")


@query(f"WITH {G}, h AS (SELECT row_id, list(item) OVER (PARTITION BY user_id ORDER BY ts, item, row_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS history FROM g) SELECT row_id, array_to_string(history, ',') AS history FROM h WHERE len(history) > 0")
def prefix_history(spark, d):
    return sequence.prefix_history(T.signals(spark, d), 10).select("row_id", F.array_join("history", ",").alias("history"))


@query(f"""WITH {G}, q AS (SELECT DISTINCT user_id, CAST({Q} AS BIGINT) AS query_ts FROM g), x AS (SELECT user_id, ts, CASE WHEN row_id % 3 = 0 THEN '' ELSE aspect END AS text FROM g)
  SELECT q.user_id, coalesce(nullif((SELECT max_by(text, ts) FROM x WHERE x.user_id = q.user_id AND ts <= query_ts), ''), (SELECT min_by(text, ts) FROM x WHERE x.user_id = q.user_id)) AS text FROM q""")
def asof_text(spark, d):
    g = T.signals(spark, d)
    texts = g.select("user_id", "ts", F.when(F.col("row_id") % 3 == 0, "").otherwise(F.col("aspect")).alias("text"))
    return sequence.asof_text(T.queries_at(g), texts).select("user_id", "text")


@query(f"WITH {G} SELECT row_id, CAST(greatest(0, least(239, floor((ts - 1704067200000000) / 86400000000::DOUBLE) - 15 + 120)) AS INT) AS bucket FROM g")
def time_buckets(spark, d):
    day = sequence.day_index(F.col("ts"), F.lit(1_704_067_200_000_000))
    return T.signals(spark, d).select("row_id", sequence.time_bucket(F.lit(15), day).alias("bucket"))


# ------------------------------------------------------------------ co-visits
COV = f"u AS ({GI}), cv AS (SELECT a.item AS anchor, b.item AS co, count(*) AS n FROM u a JOIN u b ON a.user_id = b.user_id AND a.item <> b.item GROUP BY 1, 2)"


@query(f"WITH {G}, {COV} SELECT anchor, co, n FROM cv")
def covisit_edges(spark, d):
    return covisit.covisit_edges(T.signals(spark, d))


@query(f"""WITH {G}, {COV}, wr AS (SELECT DISTINCT user_id, item FROM g WHERE polarity > 0) SELECT a.item AS anchor, b.item AS co, count(*) AS n FROM wr a JOIN u b ON a.user_id = b.user_id AND a.item <> b.item GROUP BY 1, 2""")
def covisit_reviewed(spark, d):
    g = T.signals(spark, d)
    return covisit.covisit_edges(g, g.select("user_id", "item", F.when(F.col("polarity") > 0, "x").otherwise(" ").alias("text")))


@query(f"""WITH {G}, {COV}, an AS (SELECT user_id, item FROM g), t AS (SELECT an.user_id, cv.co AS item, sum(n) AS n FROM an JOIN cv ON cv.anchor = an.item JOIN u ON u.user_id = an.user_id AND u.item = cv.co GROUP BY 1, 2)
  SELECT user_id, item, round(n / (max(n) OVER (PARTITION BY user_id))::DOUBLE, 6) AS score FROM t""")
def coitem_scores(spark, d):
    g = T.signals(spark, d)
    return r6(covisit.coitem_scores(g, g, covisit.covisit_edges(g)), "score")


KNN = f"{COV}, sz AS (SELECT item, count(*) AS c FROM u GROUP BY 1), sim AS (SELECT anchor, co, n / sqrt(a.c * b.c::DOUBLE) AS s FROM cv JOIN sz a ON a.item = anchor JOIN sz b ON b.item = co UNION ALL SELECT item, item, 1.0 FROM sz)"


@query(f"WITH {G}, {KNN} SELECT anchor, co, round(s, 6) AS similarity FROM sim")
def item_similarity(spark, d):
    return r6(covisit.item_similarity(T.signals(spark, d)), "similarity")


@query(f"WITH {G}, {KNN}, {_HALF}" + _whole_sql(KNN_SQL))
def itemknn_scores(spark, d):
    return _whole(T.signals(spark, d), "itemknn")


#: Signals before the query time as training rows g, the pairs after it as gold; every model's score of each item that a user has
#: not seen or has as gold, and the place of the gold items.
_EVAL = f"""{G.replace("g AS (", "g0 AS (", 1)}, g AS MATERIALIZED (SELECT * FROM g0 WHERE ts < {Q}), gold AS MATERIALIZED (SELECT DISTINCT user_id, item FROM g0 WHERE ts >= {Q}), {NEXT_WITH}, {MARKOV_WITH}, {KNN},
  c AS MATERIALIZED (SELECT user_id, item FROM (SELECT DISTINCT user_id FROM gold), (SELECT DISTINCT item FROM g) EXCEPT SELECT user_id, item FROM g UNION SELECT user_id, item FROM gold),
  sc AS (SELECT 'sequential' AS model, * FROM ({NEXT_SQL}) UNION ALL SELECT 'markov', * FROM ({MARKOV_SQL}) UNION ALL SELECT 'itemknn', * FROM ({KNN_SQL}) UNION ALL SELECT 'popularity', user_id, item, (SELECT count(*) FROM g WHERE g.item = c.item)::DOUBLE FROM c),
  rk AS (SELECT *, row_number() OVER (PARTITION BY model, user_id ORDER BY score DESC, item) AS rank FROM sc), gr AS (SELECT rk.* FROM rk JOIN gold USING (user_id, item))"""


def _models_and_gold(spark, d):
    g = save(T.signals(spark, d), "signals")
    train, gold = g.where(F.col("ts") < T.QUERY_TS), g.where(F.col("ts") >= T.QUERY_TS).select("user_id", "item").distinct()
    found = {n: m._replace(hits=m.hits.withColumn("score", F.round("score", 9))) for n, m in recommend.models(train).items()}
    return found, train, gold


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {_EVAL} SELECT model, user_id, item, round(score, 6) AS score, rank FROM gr")
def catalogue_places(spark, d):
    """The exact place of each later item among the whole catalogue, under four models."""
    found, train, gold = _models_and_gold(spark, d)
    return _union([r6(catalogue.gold_places(m, gold, train).select(F.lit(n).alias("model"), "user_id", "item", "score", "rank"), "score") for n, m in found.items()])


@query(f"""WITH {_EVAL}, mu AS (SELECT model, user_id, max(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END) AS hr, count(*) FILTER (WHERE rank <= 10) / count(*)::DOUBLE AS recall, coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE rank <= 10), 0) AS mrr FROM gr GROUP BY 1, 2)
  SELECT model, count(*) AS n_users, round(avg(hr), 6)::DOUBLE AS hr_10, round(avg(recall), 6) AS recall_10, round(avg(mrr), 6) AS mrr_10 FROM mu GROUP BY 1""")
def model_evaluation(spark, d):
    """Four models over the whole catalogue, seen items left out: their means over users."""
    found, train, gold = _models_and_gold(spark, d)
    return _union([recommend.evaluate(m, train, gold, (10,)).agg(F.lit(n).alias("model"), F.count("*").alias("n_users"), *(F.round(F.avg(c), 6).alias(c) for c in ("hr_10", "recall_10", "mrr_10"))) for n, m in found.items()])


@query()
def als_scores(spark, d):
    """The 20 best items of the whole catalogue for each user under alternating least squares with eight factors."""
    g = T.signals(spark, d)
    found = covisit.als_factors(g, clean.id_maps(g, column="user_id"), clean.id_maps(g), factors=8)
    return factors.factor_best(found, g, 20).select("user_id", "item", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query()
def svd_topk(spark, d):
    """The 20 best items of the whole catalogue for each user under the truncated SVD with eight factors."""
    g = T.signals(spark, d)
    return factors.factor_best(factors.truncated_svd(g, 8), g, 20).select("user_id", "item", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


# ------------------------------------------------------------------ rankings
@query(f"""WITH {S}, pop AS (SELECT item, count(*) AS c FROM tr GROUP BY 1), top AS (SELECT item, c FROM pop ORDER BY c DESC, item LIMIT 200), cand AS (SELECT u.user_id, top.item, c FROM (SELECT DISTINCT user_id FROM te) u, top WHERE (u.user_id, top.item) NOT IN (SELECT (user_id, item) FROM tr))
  SELECT user_id, item, CAST(rank AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, item) AS rank FROM cand) WHERE rank <= 10""")
def popularity_topk(spark, d):
    s = save(pairs_split(spark, d), "split")
    return ranked(ranking.popular_unseen(clean.part(s, "train"), clean.part(s, "test"), 10))


_POPM = f"""{S}, pop AS (SELECT item, count(*) AS c FROM tr GROUP BY 1), goal AS (SELECT DISTINCT user_id, item FROM te), sn AS (SELECT user_id, item FROM tr EXCEPT SELECT user_id, item FROM goal), top AS (SELECT item, c FROM pop ORDER BY c DESC, item LIMIT 220),
  cand AS (SELECT * FROM (SELECT u.user_id, top.item, c FROM (SELECT DISTINCT user_id FROM goal) u, top WHERE (u.user_id, top.item) NOT IN (SELECT (user_id, item) FROM sn)) UNION SELECT user_id, item, coalesce(c, 0) FROM goal LEFT JOIN pop USING (item)),
  rk AS (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, item) AS rank FROM cand), ht AS (SELECT goal.user_id, goal.item, rank FROM goal LEFT JOIN rk USING (user_id, item)),
  pm AS (SELECT user_id, count(*) AS n_relevant, max(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END) AS hr_10, count(*) FILTER (WHERE rank <= 10) / count(*)::DOUBLE AS recall_10,
    sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(range(1, CAST(least(count(*), 10) AS INT) + 1), lambda x: 1 / log2(x + 1))) AS ndcg_10, coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE rank <= 10), 0) AS mrr_10 FROM ht GROUP BY 1)"""


def _popular_metrics(spark, d):
    s = save(pairs_split(spark, d), "split")  # read many times below
    train, goal = clean.part(s, "train"), clean.part(s, "test").select("user_id", "item").distinct()
    return metrics.rank_metrics(ranking.popular_unseen(train, goal.select("user_id").distinct(), 20, goal), goal, (10,))


@query(f"WITH {_POPM} SELECT user_id, n_relevant, hr_10::DOUBLE AS hr_10, round(recall_10, 6) AS recall_10, round(ndcg_10, 6) AS ndcg_10, round(mrr_10, 6) AS mrr_10 FROM pm")
def rank_metrics(spark, d):
    return r6(_popular_metrics(spark, d), "recall_10", "ndcg_10", "mrr_10")


@query(f"WITH {_POPM} SELECT count(*) AS n_users, round(avg(hr_10), 6)::DOUBLE AS hr_10, round(avg(recall_10), 6) AS recall_10, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(mrr_10), 6) AS mrr_10 FROM pm")
def flagship(spark, d):
    """Order lines to interactions, earliest per pair, chronological split, popularity lists, metrics, means over users."""
    m = _popular_metrics(spark, d)
    return m.agg(F.count("*").alias("n_users"), *(F.round(F.avg(c), 6).alias(c) for c in ("hr_10", "recall_10", "ndcg_10", "mrr_10")))


@query(f"""WITH {_POPM}, l AS (SELECT user_id, 'recall_10' AS metric, recall_10 AS value FROM pm UNION ALL SELECT user_id, 'ndcg_10', ndcg_10 FROM pm) SELECT metric, round(avg(value), 6) AS mean FROM l GROUP BY 1""")
def user_means(spark, d):
    return r6(metrics.means(metrics.long_form(_popular_metrics(spark, d), ["recall_10", "ndcg_10"])), "mean")


@query(f"WITH {S}, pop AS (SELECT item, count(*) AS c FROM tr GROUP BY 1), cs AS (SELECT user_id, item FROM s WHERE split = 'valid'), cand AS (SELECT u.user_id, pop.item, c FROM (SELECT DISTINCT user_id FROM cs) u, (SELECT * FROM pop ORDER BY c DESC, item LIMIT 250) pop WHERE (u.user_id, pop.item) NOT IN (SELECT (user_id, item) FROM tr)), rk AS (SELECT user_id, item FROM cand QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC, item) <= 50) SELECT count(*) AS n_cases, round(avg(CASE WHEN rk.item IS NULL THEN 0.0::DOUBLE ELSE 1 END), 6) AS recall FROM cs LEFT JOIN rk USING (user_id, item)")
def pool_recall(spark, d):
    s = save(pairs_split(spark, d), "split")
    return r6(metrics.pool_recall(clean.part(s, "train"), clean.part(s, "valid").select("user_id", "item")), "recall")


@query()
def sampled_evaluation(spark, d):
    s = save(pairs_split(spark, d), "split")  # read many times below
    train = clean.part(s, "train")
    return recommend.evaluate_sampled(recommend.scorers(train)["popularity"], train, clean.part(s, "test"), 20)


MERGED = "SELECT user_id, item, r2 AS place, 0 AS part FROM pool WHERE r2 <= 5"


@query(f"WITH {G}, {POOL}, h AS (SELECT * FROM pool WHERE r2 <= 5) SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY part, place) AS rank FROM (SELECT user_id, item, 0 AS part, r2 AS place FROM h UNION ALL SELECT user_id, item, 1, rank FROM pool WHERE rank > 5 AND (user_id, item) NOT IN (SELECT (user_id, item) FROM h))")
def merge_ranking(spark, d):
    p = signal_pool(spark, d)
    return ranked(ranking.merge_ranking(p.where("r2 <= 5").select("user_id", "item", F.col("r2").alias("rank")), p, 5))


def _other(p: DataFrame) -> DataFrame:
    return p.select("user_id", "item", F.col("r2").alias("rank"))


@query(f"WITH {G}, {POOL} SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN rank <= 8 THEN 0 ELSE 1 END, CASE WHEN rank <= 8 THEN r2 ELSE rank END) AS rank FROM pool")
def reorder_head(spark, d):
    p = signal_pool(spark, d)
    return ranked(ranking.reorder_head(p, _other(p), 8))


@query(f"WITH {G}, {POOL} SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN r2 <= 4 THEN 0 ELSE 1 END, CASE WHEN r2 <= 4 THEN r2 ELSE rank END) AS rank FROM pool")
def promote_then_fill(spark, d):
    p = signal_pool(spark, d)
    return ranked(ranking.promote_then_fill(p, _other(p), 4))


@query(f"""WITH {G}, {POOL}, k AS (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY r2) AS nth FROM pool WHERE rank > 3), x AS (SELECT pool.*, CASE WHEN nth <= 2 THEN nth END AS nth FROM pool LEFT JOIN k USING (user_id, item))
  SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN nth IS NOT NULL THEN 1 WHEN rank <= 3 THEN 0 ELSE 2 END, coalesce(nth, rank)) AS rank FROM x""")
def promote_after_head(spark, d):
    p = signal_pool(spark, d)
    return ranked(ranking.promote_after_head(p, _other(p), 2, 3))


@query(f"""WITH {G}, {POOL}, k AS (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY r2) AS nth FROM pool WHERE rank > 10), x AS (SELECT pool.*, CASE WHEN nth <= 2 THEN nth END AS nth, count(*) OVER (PARTITION BY user_id) AS size FROM pool LEFT JOIN k USING (user_id, item)),
  y AS (SELECT *, least(size, 10) AS e, count(nth) OVER (PARTITION BY user_id) AS got FROM x) SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN nth IS NOT NULL THEN 1 WHEN rank <= e - got THEN 0 WHEN rank <= e THEN 2 ELSE 3 END, coalesce(nth, rank)) AS rank FROM y""")
def promote_swap(spark, d):
    p = signal_pool(spark, d)
    return ranked(ranking.promote_swap(p, _other(p), 2, 8))


@query(f"WITH {G}, {POOL} SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY round(0.7::DOUBLE * (rank - 1) + 0.3::DOUBLE * (r2 - 1), 9), rank) AS rank FROM pool")
def blend_ranks(spark, d):
    p = signal_pool(spark, d)
    return ranked(ranking.blend_ranks(p, _other(p), 0.3))


@query(f"WITH {G}, {POOL} SELECT user_id, bool_and(r2 <= 40) AS ok FROM pool WHERE rank <= 3 GROUP BY 1")
def guardrail(spark, d):
    p = signal_pool(spark, d)
    return ranking.guardrail(p, _other(p), 3, 40)


@query(f"WITH {G}, {POOL}, z AS (SELECT user_id, item, min(struct_pack(part := part, place := place)) AS o FROM (SELECT user_id, item, 0 AS part, r2 AS place FROM pool WHERE r2 <= 3 UNION ALL SELECT user_id, item, 1, rank FROM pool) GROUP BY 1, 2) SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY o) AS rank FROM z WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.user_id = z.user_id AND p.item = z.item AND p.r2 = 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY o) <= 12")
def union_by_priority(spark, d):
    p = signal_pool(spark, d)
    gone = p.where("r2 = 2").select("user_id", "item")
    return ranked(ranking.union_by_priority([_other(p).where("rank <= 3"), p], 12, gone))


@query("""WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS item, embedding AS e FROM embeddings), q AS (SELECT * FROM v WHERE CAST(item AS INT) % 50 = 0), t AS (SELECT q.item AS user_id, v.item, list_cosine_similarity(q.e::DOUBLE[], v.e::DOUBLE[]) AS s FROM q, v)
  SELECT user_id, item, round(s, 5) AS score FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(s, 9) DESC, item) <= 10""")
def cosine_topk(spark, d):
    v = T.vectors(spark, d)
    q = v.where(F.col("item").cast("int") % 50 == 0).select(F.col("item").alias("user_id"), F.col("vector").alias("query"))
    return ranking.vector_topk(q, v.select("item", "vector"), 10).select("user_id", "item", F.round("score", 5).alias("score"))


# ------------------------------------------------------------------ features
@query(f"WITH {G}, {POOL}, z AS (SELECT *, avg(n) OVER (PARTITION BY user_id) AS mu, stddev_pop(n) OVER (PARTITION BY user_id) AS sd, min(n) OVER (PARTITION BY user_id) AS lo, max(n) OVER (PARTITION BY user_id) AS hi FROM pool) SELECT user_id, item, round(CASE WHEN sd < 1e-12 THEN 0 ELSE (n - mu) / sd END, 6) AS z, round(CASE WHEN hi - lo < 1e-12 THEN 0 ELSE (n - lo) / (hi - lo)::DOUBLE END, 6) AS scaled FROM z")
def zscore_minmax(spark, d):
    w = Window.partitionBy("user_id")
    return signal_pool(spark, d).select("user_id", "item", F.round(C.zscore(F.col("n"), w), 6).alias("z"), F.round(C.minmax(F.col("n"), w), 6).alias("scaled"))


def _channels(spark, d) -> DataFrame:
    p = signal_pool(spark, d)
    return p.select("user_id", "item", "rank", F.col("n").cast("double").alias("seq"), F.col("r2").cast("double").alias("text"), (F.col("n") * F.col("r2")).cast("double").alias("co"), F.lit(1.0).alias("hist"), F.length("item").cast("double").alias("cat"), F.col("item").cast("double").alias("pop"))


_Z = f"{POOL}, ch AS (SELECT user_id, item, rank, n::DOUBLE AS seq, r2::DOUBLE AS text, (n * r2)::DOUBLE AS co, length(item)::DOUBLE AS cat, item::DOUBLE AS pop FROM pool), zz AS (SELECT user_id, item, rank" + "".join(
    f", CASE WHEN stddev_pop({c}) OVER w < 1e-12 THEN 0 ELSE ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w END AS z_{c}" for c in ("seq", "text", "co", "cat", "pop")
) + " FROM ch WINDOW w AS (PARTITION BY user_id))"


@query(f"WITH {G}, {_Z}, lv AS (SELECT *, CASE WHEN max(abs(z_text)) OVER w > 0 THEN 0.45 ELSE 0 END::DOUBLE AS a, CASE WHEN max(abs(z_co)) OVER w > 0 THEN 0.25 ELSE 0 END::DOUBLE AS b, CASE WHEN max(abs(z_seq)) OVER w > 0 THEN 0.10 ELSE 0 END::DOUBLE AS c FROM zz WINDOW w AS (PARTITION BY user_id)) SELECT user_id, item, round(CASE WHEN a + b + c > 0 THEN (a * z_text + b * z_co + c * z_seq) / (a + b + c) ELSE 0 END, 6) AS phi FROM lv")
def potential(spark, d):
    return r6(features.mix_channels(features.with_zscores(_channels(spark, d))), "phi").select("user_id", "item", "phi")


@query(f"WITH {G}, {_Z} SELECT user_id, item, round(-ln(rank), 6) AS neg_log_rank, round(1.0::DOUBLE / rank, 6) AS inv_rank, round(coalesce(z_seq - max(CASE WHEN rank = 10 THEN z_seq END) OVER (PARTITION BY user_id), 0), 6) AS seq_gap_r10, round(z_cat * -z_pop, 6) AS z_cat_unpop, round(CASE WHEN rank > 20 THEN z_text ELSE 0 END, 6) AS z_text_tail FROM zz")
def ltr_features(spark, d):
    f = features.ltr_features(features.with_zscores(_channels(spark, d)))
    names = ("neg_log_rank", "inv_rank", "seq_gap_r10", "z_cat_unpop", "z_text_tail")
    return r6(f, *names).select("user_id", "item", *names)


@query()
def listwise_oof(spark, d):
    rows = features.ltr_features(features.with_zscores(_channels(spark, d))).withColumn("label", (F.col("text") <= 3).cast("int"))
    return r6(features.out_of_fold(rows, folds=2), "score").select("user_id", "item", "score")


@query()
def boosted_oof(spark, d):
    """Gradient-boosted trees on the listwise features without those of the rank, each user scored by a model of the other folds."""
    rows = save(features.ltr_features(features.with_zscores(_channels(spark, d))).withColumn("label", (F.col("text") <= 3).cast("int")), "rows")
    return r6(boosting.boosted_out_of_fold(rows, features.LTR_FEATURES[3:], folds=2, trees=12, depth=3), "score").select("user_id", "item", "score")


@query()
def greedy_swaps(spark, d):
    pool = signal_pool(spark, d).select("user_id", "item", "rank", (1.0 / F.col("r2")).alias("phi"))
    return features.greedy_swaps(pool)


@query(f"WITH {M}, t AS (SELECT item, {TOKENS.format('name')} AS a, {TOKENS.format('categories')} AS b FROM m) SELECT item, CAST(len(a) AS INT) AS n_tokens, CAST(len(list_intersect(a, ['almond', 'antique', 'blue', 'steel', 'copper'])) AS INT) AS hits, round(len(list_intersect(a, b)) / greatest(len(a), 1)::DOUBLE, 6) AS overlap FROM t")
def token_overlap(spark, d):
    a, b = C.tokens(F.col("name")), C.tokens(F.col("categories"))
    wanted = F.array(*map(F.lit, ("almond", "antique", "blue", "steel", "copper")))
    return T.items(spark, d).select("item", F.size(a).alias("n_tokens"), C.hits(a, wanted).alias("hits"), F.round(C.overlap(a, b), 6).alias("overlap"))


def _jaccard_sql(make: str, k: int) -> str:
    return f"""WITH {G}, {M}, t AS (SELECT item, {make} AS t FROM m), rc AS (SELECT user_id, item FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item DESC, row_id DESC) <= {k}),
      h AS (SELECT user_id, list_distinct(flatten(list(t))) AS h FROM rc JOIN t USING (item) GROUP BY 1), c AS ({GI})
      SELECT c.user_id, c.item, round(coalesce(len(list_intersect(coalesce(t, []), coalesce(h, []))) / nullif(len(list_distinct(list_concat(coalesce(t, []), coalesce(h, [])))), 0)::DOUBLE, 0), 6) AS score FROM c LEFT JOIN t USING (item) LEFT JOIN h USING (user_id)"""


@query(_jaccard_sql("list_distinct(list_filter(list_transform(string_split(lower(categories), ','), lambda x: trim(x)), lambda x: x <> ''))", 5))
def category_jaccard(spark, d):
    g = T.signals(spark, d)
    return r6(features.history_jaccard(g.select("user_id", "item").distinct(), g, T.items(spark, d), "categories", 5), "score")


@query(_jaccard_sql("list_filter(regexp_split_to_array(translate(lower(name), '/-', '  '), '\\s+'), lambda x: length(x) >= 3 AND regexp_full_match(x, '[a-z0-9]+'))[1:6]", 3))
def name_jaccard(spark, d):
    g = T.signals(spark, d)
    return r6(features.history_jaccard(g.select("user_id", "item").distinct(), g, T.items(spark, d), "name", 3), "score")


@query(f"""WITH {G}, {POOL}, mg AS (SELECT user_id, max(n) FILTER (WHERE rank = 1) / 10.0::DOUBLE - max_by(n, rank) FILTER (WHERE rank <= 5) / 10.0::DOUBLE AS x FROM pool GROUP BY 1), cf AS (SELECT user_id, 1 / (1 + exp(-x)) AS margin FROM mg)
  SELECT user_id, round(margin, 6) AS margin, CAST(greatest(3, least(8, round_even(5 + 3 * (1 - 2 * margin), 0))) AS INT) AS n_u, CAST(greatest(8, least(15, round_even(10 + 5 * (2 * margin - 1), 0))) AS INT) AS m_u, CASE WHEN margin < 0.45 THEN 'low_c_u' WHEN margin > 0.53 THEN 'high_stage1_margin' ELSE 'ok' END AS gate FROM cf""")
def confidence_window(spark, d):
    c = features.margin_confidence(signal_pool(spark, d).withColumn("score", F.col("n") / 10.0))
    m = F.col("margin")
    return c.select("user_id", F.round(m, 6).alias("margin"), *features.confidence_window(features.alignment_confidence(m, F.lit(None).cast("double"))), features.gate(m, m, max_margin=0.53).alias("gate"))


@query(f"WITH {G}, {POOL}, l AS (SELECT *, CASE WHEN length(item) = 1 THEN 1 ELSE 0 END AS label FROM pool), r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY n) + (count(*) OVER (PARTITION BY user_id, n) - 1) / 2.0::DOUBLE AS rk FROM l), t AS (SELECT user_id, sum(CASE WHEN label = 1 THEN rk ELSE 0 END) AS s, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM r GROUP BY 1) SELECT user_id, round(CASE WHEN p > 0 AND q > 0 THEN (s - p * (p + 1) / 2.0::DOUBLE) / (p * q) END, 6) AS auroc FROM t")
def auroc(spark, d):
    rows = signal_pool(spark, d).select("user_id", F.col("n").alias("score"), (F.length("item") == 1).cast("int").alias("label"))
    return r6(metrics.auroc(rows), "auroc")


@query(f"WITH {G}, {POOL}, r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY n, item) AS x, row_number() OVER (PARTITION BY user_id ORDER BY r2, item) AS y FROM pool) SELECT user_id, round(CASE WHEN count(*) >= 3 THEN corr(x::DOUBLE, y::DOUBLE) END, 6) AS rho FROM r GROUP BY 1")
def spearman(spark, d):
    return r6(metrics.spearman(signal_pool(spark, d), "user_id", "n", "r2", "item"), "rho")


@query(f"WITH {G}, {POOL}, a AS (SELECT rank AS r, r2 AS f FROM pool) SELECT count(*) AS n_users, count(*) FILTER (WHERE r <= 10) AS already, count(*) FILTER (WHERE r BETWEEN 11 AND 20) AS r11_20, count(*) FILTER (WHERE f <= 10 AND NOT r <= 10) AS helped, count(*) FILTER (WHERE r <= 10 AND NOT f <= 10) AS hurt, round(avg(CASE WHEN r <= 20 THEN 1.0::DOUBLE ELSE 0 END), 6) AS ceiling_20 FROM a")
def oracle_cohorts(spark, d):
    p = signal_pool(spark, d).select(F.concat_ws("/", "user_id", "item").alias("user_id"), "rank", "r2")  # each item of a user is a case
    out = metrics.oracle_cohorts(p.select("user_id", "rank"), p.select("user_id", F.col("r2").alias("rank")))
    return r6(out, "ceiling_20").select("n_users", "already", "r11_20", "helped", "hurt", "ceiling_20")


TT = f"{G}, ab AS (SELECT user_id, avg(polarity) AS a, avg(helpful) / 100 AS b FROM g GROUP BY 1), df AS (SELECT user_id AS unit, a - b AS x FROM ab)"


def _two_runs(spark, d):
    g = T.signals(spark, d).groupBy(F.col("user_id").alias("unit")).agg(F.avg("polarity").alias("a"), (F.avg("helpful") / 100).alias("b"))
    return g.select("unit", F.col("a").alias("value")), g.select("unit", F.col("b").alias("value"))


@query(f"WITH {TT} SELECT count(*) AS n, round(avg(x), 6) AS delta, round(stddev_samp(x), 6) AS sd, round(avg(x) / (stddev_samp(x) / sqrt(count(*))), 6) AS t, round(avg(x) - 1.96::DOUBLE * stddev_samp(x) / sqrt(count(*)), 6) AS low, round(avg(x) + 1.96::DOUBLE * stddev_samp(x) / sqrt(count(*)), 6) AS high FROM df")
def paired_ttest(spark, d):
    return r6(metrics.paired_ttest(*_two_runs(spark, d)).drop("p_value"), "delta", "sd", "t", "low", "high")


def _resamples(values: str, n: int) -> str:
    """SQL: the means m of n bootstrap resamples of (unit, value), by the draws of metrics.poisson_counts()."""
    chances = " + ".join(f"CAST(u > {' + '.join(f'exp(-1.0::DOUBLE) / {math.factorial(i)}' for i in range(k + 1))} AS INT)" for k in range(8))
    return f"""k0 AS (SELECT unit, value, ('0x' || substr(md5('42:' || unit), 1, 8))::UBIGINT AS key FROM ({values})), k1 AS (SELECT value, b, xor(key, (b * 2654435769 % 4294967296)::UBIGINT) AS x FROM k0, range({n}) t(b)),
  k2 AS (SELECT value, b, xor(x, x >> 16) * 2246822507::UBIGINT % 4294967296::UBIGINT AS x FROM k1), k3 AS (SELECT value, b, xor(x, x >> 13) * 3266489909::UBIGINT % 4294967296::UBIGINT AS x FROM k2),
  k4 AS (SELECT value, b, (xor(x, x >> 16)::DOUBLE + 0.5::DOUBLE) / 4294967296 AS u FROM k3), k5 AS (SELECT b, sum(value * c) / sum(c) AS m FROM (SELECT value, b, {chances} AS c FROM k4) GROUP BY 1), ms AS (SELECT list(m ORDER BY m) AS l FROM k5)"""


@query(f"""WITH {TT}, {_resamples("SELECT unit, x AS value FROM df", 200)}, o AS (SELECT avg(x) AS delta FROM df)
  SELECT round(delta, 6) AS delta, round(l[6], 6) AS low, round(l[196], 6) AS high, round(least(1.0::DOUBLE, 2.0::DOUBLE * (SELECT count(*) FROM k5 WHERE CASE WHEN delta > 0 THEN m <= 0 WHEN delta < 0 THEN m >= 0 ELSE true END) / 200), 6) AS p_value FROM o, ms""")
def paired_bootstrap(spark, d):
    return r6(metrics.paired_bootstrap(*_two_runs(spark, d), n_bootstrap=200), "delta", "low", "high", "p_value")


@query(f"""WITH {G}, ub AS (SELECT user_id AS unit, avg(polarity) AS value FROM g GROUP BY 1), {_resamples("SELECT unit, value FROM ub", 200)} SELECT round((SELECT avg(value) FROM ub), 6) AS mean, round(l[6], 6) AS low, round(l[196], 6) AS high FROM ms""")
def bootstrap_ci(spark, d):
    return r6(metrics.bootstrap_ci(_two_runs(spark, d)[0], n_bootstrap=200), "mean", "low", "high")


@query(f"WITH {G}, t AS (SELECT aspect AS metric, avg(polarity) AS base, avg(polarity * 1.01) AS fused FROM g GROUP BY 1) SELECT metric, round(base, 6) AS base, round(fused, 6) AS fused, fused + 0.0005::DOUBLE >= base AS ok FROM t")
def no_regression(spark, d):
    g = T.signals(spark, d).groupBy(F.col("aspect").alias("metric"))
    return r6(metrics.no_regression(g.agg(F.avg("polarity").alias("mean")), g.agg(F.avg(F.col("polarity") * 1.01).alias("mean")), 0.0005), "base", "fused")


# ------------------------------------------------------------------ quality of triples
def _matches(spark, d) -> DataFrame:
    return quality.matches(T.triples(spark, d), T.triples(spark, d, 1))


@query(f"WITH {MATCH}, t AS (SELECT {COUNTS} FROM mt) SELECT tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, {F1} FROM t")
def quality_micro(spark, d):
    return r6(quality.micro(_matches(spark, d)), "precision", "recall", "f1")


@query(f"WITH {MATCH}, t AS (SELECT review_id, {COUNTS} FROM mt GROUP BY 1), f AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f FROM t) SELECT round(avg(f), 6) AS f1, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM f")
def quality_macro_review(spark, d):
    return r6(quality.macro_review(_matches(spark, d)), "f1")


@query(f"WITH {MATCH}, t AS (SELECT aspect, {COUNTS} FROM mt GROUP BY 1) SELECT aspect, tp, fp, fn, {F1} FROM t")
def quality_per_aspect(spark, d):
    return r6(quality.prf(_matches(spark, d), "aspect"), "f1").select("aspect", "tp", "fp", "fn", "f1")


@query(f"WITH {MATCH}, t AS (SELECT aspect, {COUNTS} FROM mt GROUP BY 1) SELECT round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)), 6) AS f1, count(*) AS n_aspects FROM t WHERE tp + fn >= 5")
def quality_macro_aspect(spark, d):
    return r6(quality.macro_aspect(_matches(spark, d)), "f1")


@query(f"WITH {MATCH}, t AS (SELECT sentiment, {COUNTS} FROM mt GROUP BY 1), r AS (SELECT sentiment, avg(f) AS macro_f1 FROM (SELECT sentiment, review_id, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f FROM (SELECT sentiment, review_id, {COUNTS} FROM mt GROUP BY 1, 2)) GROUP BY 1) SELECT sentiment, {F1}, round(macro_f1, 6) AS macro_f1, tp + fn AS support, tp + fn < 10 AS low_support FROM t JOIN r USING (sentiment)")
def quality_per_sentiment(spark, d):
    return r6(quality.per_sentiment(_matches(spark, d)), "f1", "macro_f1").select("sentiment", "f1", "macro_f1", "support", "low_support")


@query(f"""WITH {MATCH}, a AS (SELECT review_id, aspect, bool_or(p) AS p, bool_or(g) AS g, bool_or(p AND g) AS same FROM mt GROUP BY 1, 2), r AS (SELECT review_id, bool_or(g AND NOT p) AS missed, bool_or(p AND NOT g) AS spurious, bool_or(p AND g AND NOT same) AS flip FROM a GROUP BY 1), x AS (SELECT review_id, bool_and(p AND g) AS perfect FROM mt GROUP BY 1)
  SELECT count(*) FILTER (WHERE perfect) AS perfect, count(*) FILTER (WHERE missed) AS missed, count(*) FILTER (WHERE spurious) AS spurious, count(*) FILTER (WHERE flip) AS sentiment_flip FROM r JOIN x USING (review_id)""")
def quality_errors(spark, d):
    return quality.error_summary(_matches(spark, d))


@query(f"WITH {TG}, n AS (SELECT o_orderkey AS review_id, (SELECT count(*) FROM tp WHERE review_id = o_orderkey) AS n FROM orders) SELECT count(*) AS n_reviews, count(*) FILTER (WHERE n > 0) AS with_triples, count(*) FILTER (WHERE n = 0) AS empty, CAST(sum(n) AS BIGINT) AS n_triples, round(avg(n), 6) AS mean_triples FROM n")
def triple_summary(spark, d):
    t = T.triples(spark, d)
    return r6(quality.summary(T.table(spark, d, "orders").select(F.col("o_orderkey").alias("review_id")), t), "mean_triples")


@query(f"WITH {TG}, c AS (SELECT aspect, count(*) AS n FROM tp GROUP BY 1 HAVING count(*) >= 5) SELECT CAST(row_number() OVER (ORDER BY n DESC, aspect) AS INT) AS id, aspect, n FROM c QUALIFY row_number() OVER (ORDER BY n DESC, aspect) <= 4 UNION ALL SELECT 0, 'OTHER', 0")
def aspect_vocabulary(spark, d):
    return quality.aspect_vocabulary(T.triples(spark, d), 4)


@query(f"WITH {TG} SELECT review_id, aspect, sentiment, round(max(confidence), 6) AS confidence FROM tp WHERE confidence >= 0.5 GROUP BY 1, 2, 3")
def finalized_triples(spark, d):
    return r6(quality.finalize(T.triples(spark, d), 0.5), "confidence")


@query(f"WITH {TG}, a AS (SELECT review_id, list(DISTINCT aspect || '|' || sentiment) AS x FROM tp GROUP BY 1), b AS (SELECT review_id, list(DISTINCT aspect || '|' || sentiment) AS y FROM tg GROUP BY 1) SELECT count(*) AS n, round(avg(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE), 6) AS jaccard FROM a JOIN b USING (review_id)")
def annotator_agreement(spark, d):
    return r6(quality.agreement(T.triples(spark, d), T.triples(spark, d, 1)), "jaccard")


# ------------------------------------------------------------------ graph and text
@query(f"""WITH {INTEREST}, {SENT}, f AS (SELECT count(*) AS n FROM ({GI})), h AS (SELECT count(*) AS n, round(sum(score), 6) AS w FROM e), pr AS (SELECT count(*) AS n, round(sum(gamma), 6) AS w FROM it WHERE abs(gamma) >= 1e-9), x AS (SELECT 'reviewed' AS relation, n, n::DOUBLE AS weight FROM f UNION ALL SELECT 'reviewed_by', n, n FROM f UNION ALL SELECT 'has_sentiment', n, w FROM h UNION ALL SELECT 'sentiment_of', n, w FROM h UNION ALL SELECT 'prefers', n, w FROM pr UNION ALL SELECT 'preferred_by', n, w FROM pr) SELECT relation, n, round(weight, 4) AS weight FROM x""")
def graph_edges(spark, d):
    g = T.signals(spark, d)
    e = graph.edges(g, signals.item_sentiment(g), graph.preference_edges(g, T.QUERY_TS - 1))
    return e.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.round(F.sum("weight"), 6), 4).alias("weight"))


@query(f"""WITH {G}, v AS (SELECT aspect, row_number() OVER (ORDER BY count(*) DESC, aspect) AS nth FROM g GROUP BY 1), n AS (SELECT DISTINCT 0 AS part, 'user' AS kind, user_id AS key, 0 AS nth FROM g UNION ALL SELECT DISTINCT 1, 'item', item, 0 FROM g UNION ALL SELECT 2, 'aspect', aspect, nth FROM v UNION ALL SELECT 2, 'aspect', 'OTHER', 0)
  SELECT row_number() OVER (ORDER BY part, nth, key) - 1 AS id, kind, key FROM n""")
def graph_nodes(spark, d):
    g = T.signals(spark, d)
    return graph.nodes(g, quality.aspect_vocabulary(g.select("aspect"), 100, 1))


@query(f"""WITH {G}, {SENT}, v AS (SELECT 'a' || CAST(vec_id AS VARCHAR) AS aspect, embedding FROM embeddings WHERE vec_id < 8), x AS (SELECT item, i AS dim, sum((abs(score) + 0.1) * embedding[i]) / sum(abs(score) + 0.1) AS x FROM e JOIN v USING (aspect), range(1, 65) t(i) GROUP BY 1, 2) SELECT item, round(sum(abs(x)), 4) AS norm FROM x GROUP BY 1""")
def neighbour_mean(spark, d):
    g = T.signals(spark, d)
    v = T.vectors(spark, d).where("cast(item as int) < 8").select(F.concat(F.lit("a"), "item").alias("key"), "vector")
    out = graph.neighbour_mean(graph.neighbourhood(signals.item_sentiment(g)), v)
    return out.select("item", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.abs(x)), 4).alias("norm"))


@query(f"WITH {M} SELECT item, item || ' | S=' || printf('%.4f', price) || ' | name=' || CASE WHEN length(name) > 12 THEN rtrim(name[1:11]) || '…' ELSE name END || ' | cats=' || trim(string_split(categories, ',')[1]) AS card FROM m")
def item_cards(spark, d):
    m = T.items(spark, d)
    return m.select("item", text.card(F.col("item"), F.col("name"), F.col("categories"), F.col("price"), max_cats=1, max_name=12).alias("card"))


@query(f"""WITH {INTEREST}, a AS (SELECT user_id, string_agg(aspect || ' (' || printf('%.2f', weight) || ')', ', ' ORDER BY weight DESC, aspect) AS a FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, aspect) <= 3) GROUP BY 1),
  b AS (SELECT user_id, string_agg(item, ', ' ORDER BY ts, item, row_id) AS b FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item DESC, row_id DESC) <= 3) GROUP BY 1)
  SELECT user_id, 'User currently prioritizes ' || coalesce(a, 'general products') || ' based on recent reviews for items ' || b || '.' AS text FROM b LEFT JOIN a USING (user_id)""")
def preference_texts(spark, d):
    g = T.signals(spark, d)
    return text.template_text(signals.decayed_weights(g, T.queries_at(g)), g)


@query(f"WITH {G}, {M}, c AS (SELECT user_id, trim(x) AS category FROM g JOIN m USING (item), unnest(string_split(categories, ',')) t(x)), n AS (SELECT user_id, category, count(*) AS n FROM c WHERE category <> '' GROUP BY 1, 2) SELECT user_id, category, n FROM n QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) <= 5")
def category_profile(spark, d):
    return text.category_profile(T.signals(spark, d), T.items(spark, d)).select("user_id", "category", "n")


@query("SELECT conv_id, turn, length(c) AS n_note, md5(c) AS note, split_part(c, ' ', 1) AS first, split_part(c, ' ', 2) AS second FROM (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 ]', '', 'g') AS c FROM conversations)")
def tolerant_json(spark, d):
    """Answers around whole texts, a third each cut off within a code fence, with a comma too many between talk, and in order: what
    their objects hold."""
    clean_text = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 ]", "")
    rows = T.table(spark, d, "conversations").select("conv_id", "turn", clean_text.alias("c"))
    words = F.concat(F.lit('"'), F.split_part("c", F.lit(" "), F.lit(1)), F.lit('", "'), F.split_part("c", F.lit(" "), F.lit(2)), F.lit('"'))
    body = F.concat(F.lit('{"note": "'), F.col("c"), F.lit('", "ranked_item_ids": ['), words)
    kind = (F.col("conv_id") + F.col("turn")) % 3
    raw = F.when(kind == 0, F.concat(F.lit("```json\n"), body)).when(kind == 1, F.concat(F.lit("Sure, here it is: "), body, F.lit(",]} Anything else?"))).otherwise(F.concat(body, F.lit("]}\n```")))
    found = text.tolerant_json(rows.withColumn("raw", raw), "raw").withColumn("o", F.from_json("json", "note string, ranked_item_ids array<string>"))
    return found.select("conv_id", "turn", F.length("o.note").cast("long").alias("n_note"), F.md5("o.note").alias("note"), F.get("o.ranked_item_ids", 0).alias("first"), F.get("o.ranked_item_ids", 1).alias("second"))


@query()
def hash_vectors(spark, d):
    v = text.hash_vector(F.col("name"), 64)
    return T.items(spark, d).select("item", F.size(v).alias("n"), F.round(F.aggregate(F.map_values(v), F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


@query()
def extracted_triples(spark, d):
    from ..operators.inference import extract_triples

    rows = T.table(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("review_id"), F.concat(F.lit("good service. "), F.coalesce("text", F.lit(""))).alias("text"))
    return extract_triples(rows).select("review_id", F.size("triples").alias("n"), "error")


@query()
def batches(spark, d):
    from ..operators.inference import form_batches

    return form_batches(T.signals(spark, d).select("user_id", "ts", F.col("helpful").alias("cost")), 8, 400).groupBy("batch").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ the second stage and streams
@query()
def second_stage(spark, d):
    from .rerank import second_stage as plan

    g = T.signals(spark, d)
    stage1 = save(signal_pool(spark, d).select("user_id", "item", "rank", (F.col("n") / 10.0).alias("score")), "stage1")
    texts = text.category_profile(g, T.items(spark, d)).groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("category")), " ").alias("text"))
    boosts = save(covisit.coitem_scores(g, g, covisit.covisit_edges(g)), "boosts")
    return plan(stage1, boosts, texts, T.items(spark, d)).select("user_id", "item", "rank")


@query(f"WITH {G}, {POOL} SELECT count(*) AS near_misses, count(*) FILTER (WHERE r2 > 30) AS shortlist_miss, count(*) FILTER (WHERE r2 <= 30 AND r2 > 15) AS pick_miss, count(*) FILTER (WHERE r2 <= 15 AND r2 > 10) AS placement_miss, count(*) FILTER (WHERE r2 <= 10) AS rescued FROM pool WHERE rank BETWEEN 11 AND 100")
def funnel_audit(spark, d):
    from ..operators.rerank import funnel_audit as audit

    p = signal_pool(spark, d)
    other = _other(p)
    return audit(p.select("user_id", "item"), p, other.where("rank <= 30"), other.where("rank <= 15"), other)


@query(f"WITH {G}, {POOL} SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN rank BETWEEN 11 AND 20 THEN 0 ELSE 1 END, CASE WHEN rank BETWEEN 11 AND 20 THEN rank END, r2 DESC, rank) AS rank FROM pool QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN rank BETWEEN 11 AND 20 THEN 0 ELSE 1 END, CASE WHEN rank BETWEEN 11 AND 20 THEN rank END, r2 DESC, rank) <= 15")
def focus_list(spark, d):
    from ..operators.rerank import focus

    return ranked(focus(signal_pool(spark, d).select("user_id", "item", "rank", F.col("r2").alias("hits")), 15))


@query(f"WITH {G}, {POOL} SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN r2 <= 5 THEN r2 END NULLS LAST, n DESC, item) AS rank FROM pool")
def repaired_list(spark, d):
    from ..operators.rerank import repaired

    p = signal_pool(spark, d)
    return ranked(repaired(_other(p).where("rank <= 5"), p.select("user_id", "item", F.col("n").alias("total")), p))


@query(f"WITH {G}, {SENT} SELECT item, CAST(count(*) AS INT) AS n_aspects, round(max(e_hat) FILTER (WHERE aspect = 'a1'), 6) AS a1 FROM eh GROUP BY 1")
def aspect_maps(spark, d):
    from ..operators.rerank import aspect_maps as maps

    m = maps(signals.item_sentiment(T.signals(spark, d)))
    return m.select("item", F.size("scores").alias("n_aspects"), F.round(F.try_element_at("e_hats", F.lit("a1")), 6).alias("a1"))


@query(f"""WITH {INTEREST}, vv AS (SELECT CAST(vec_id AS VARCHAR) AS key, embedding AS e FROM embeddings), mv AS (SELECT user_id, i AS dim, sum(x) AS x FROM (SELECT user_id, i, gamma * e[i] AS x FROM it JOIN vv ON vv.key = substr(aspect, 2), range(1, 65) t(i) UNION ALL SELECT key, i, e[i]::DOUBLE FROM vv, range(1, 65) t(i)) GROUP BY 1, 2),
  cc AS (SELECT u.user_id, v.item FROM (SELECT DISTINCT user_id FROM g) u, (SELECT DISTINCT item FROM g) v), sc AS (SELECT user_id, item, coalesce((SELECT sum(x * e[dim]) FROM mv, vv WHERE mv.user_id = cc.user_id AND vv.key = cc.item AND cc.user_id IN (SELECT key FROM vv)), 0) AS s FROM cc)
  SELECT user_id, item, round(CASE WHEN max(s) OVER w - min(s) OVER w < 1e-12 THEN 0 ELSE (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) END, 5) AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(s, 12) DESC, item) AS rank
  FROM sc WINDOW w AS (PARTITION BY user_id)""")
def adjusted_scores(spark, d):
    """Every item of the whole catalogue for each user by vectors moved along the user's aspects."""
    from ..operators.rerank import adjusted_best

    g, v = T.signals(spark, d), T.vectors(spark, d).select(F.col("item").alias("key"), "vector")
    aspects = v.where("cast(key as int) < 8").select(F.concat(F.lit("a"), "key").alias("key"), "vector")
    gammas = signals.interest_scores(g, T.queries_at(g)).select("user_id", "aspect", "gamma")
    found = adjusted_best(g, g, v, v, aspects, gammas, None)
    return found.select("user_id", "item", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {G}, l AS (SELECT user_id, aspect, max(ts) AS last FROM g GROUP BY 1, 2) SELECT g.user_id, g.aspect, round(sum(abs(polarity) * exp(-0.01 * (last - ts) / 86400000000.0::DOUBLE)), 6) AS interest, last AS ts FROM g JOIN l USING (user_id, aspect) GROUP BY g.user_id, g.aspect, last""")
def streamed_interest(spark, d):
    """The events as a stream, to its end: each (user, aspect)'s interest as of its last event, from the state's last update."""
    import uuid

    from ..streaming.decay import decayed_interest

    home = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    events = spark.readStream.schema(T.table(spark, d, "events").schema).parquet(f"{d}/events*.parquet")
    signal = T.as_signals(events).select("user_id", "aspect", "polarity", "ts")

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{home}/updates/batch={n}")

    q = decayed_interest(signal).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = "user_id string, aspect string, interest double, gamma double, ts long, batch int"
    last = spark.read.schema(schema).parquet(f"{home}/updates").groupBy("user_id", "aspect").agg(F.max_by(F.struct("interest", "ts"), "batch").alias("s"))
    return last.select("user_id", "aspect", F.round("s.interest", 6).alias("interest"), F.col("s.ts").alias("ts"))


_WIN = "w0 AS (SELECT user_id, item, r2 AS rank, rank AS stage1_rank, n % 4 AS hits, 1.0::DOUBLE / r2 AS phi, count(*) OVER (PARTITION BY user_id) AS size FROM pool), w1 AS (SELECT *, least(8, size) AS n, least(8, size) - greatest(0, least(3, least(8, size) - 1)) AS head FROM w0)"


@query(f"""WITH {G}, {POOL}, {_WIN}, w2 AS (SELECT *, CASE WHEN rank > head AND hits >= 1 THEN row_number() OVER (PARTITION BY user_id, rank > head AND hits >= 1 ORDER BY hits DESC, stage1_rank, item) END AS nth FROM w1),
  w3 AS (SELECT *, CASE WHEN rank <= head THEN 0 WHEN nth <= n - head THEN 1 ELSE 2 END AS part FROM w2)
  SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY part, CASE WHEN part = 1 THEN nth ELSE rank END) AS rank FROM w3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY part, CASE WHEN part = 1 THEN nth ELSE rank END) <= n""")
def listwise_window(spark, d):
    p = signal_pool(spark, d).select("user_id", "item", F.col("r2").alias("rank"), F.col("rank").alias("stage1_rank"), (F.col("n") % 4).alias("hits"))
    return ranked(features.listwise_window(p, 8, 3))


@query(f"""WITH {G}, {POOL}, b0 AS (SELECT user_id, item, r2 AS rank, 1.0::DOUBLE / r2 AS phi, n::DOUBLE AS text, (n * r2)::DOUBLE AS co, CASE WHEN rank <= 5 THEN rank END AS model_rank FROM pool),
  b1 AS (SELECT *, (count(*) OVER u + 1 - row_number() OVER (PARTITION BY user_id ORDER BY model_rank NULLS LAST, rank)) / (count(*) OVER u)::DOUBLE AS model FROM b0 WINDOW u AS (PARTITION BY user_id)),
  b2 AS (SELECT user_id, item, phi, """ + " + ".join(f"{w} * CASE WHEN stddev_pop({c}) OVER u > 1e-12 THEN ({c} - avg({c}) OVER u) / stddev_pop({c}) OVER u ELSE 0 END" for c, w in (("phi", "1.0::DOUBLE"), ("model", "0.5::DOUBLE"), ("text", "0.25::DOUBLE"), ("co", "0.1::DOUBLE"))) + """ AS score FROM b1 WINDOW u AS (PARTITION BY user_id))
  SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, phi DESC, item) AS rank FROM b2""")
def blend_window(spark, d):
    p = signal_pool(spark, d).select("user_id", "item", F.col("r2").alias("rank"), (1.0 / F.col("r2")).alias("phi"), F.col("n").cast("double").alias("text"), (F.col("n") * F.col("r2")).cast("double").alias("co"), F.when(F.col("rank") <= 5, F.col("rank")).alias("model_rank"))
    return ranked(features.blend_window(p, {"model": 0.5, "text": 0.25, "co": 0.1}))


@query(f"""WITH {G}, {POOL}, {SENT}, v AS (SELECT user_id, item, CASE WHEN n > 2 THEN 'budget' WHEN r2 % 2 = 0 THEN 'complaint_aspect:a1' ELSE 'price_unknown' END AS violation FROM pool), ex AS (SELECT DISTINCT user_id, item FROM v WHERE violation = 'budget'),
  mi AS (SELECT DISTINCT user_id FROM v WHERE violation = 'complaint_aspect:a1'), ok AS (SELECT p.* FROM pool p LEFT JOIN mi USING (user_id) LEFT JOIN (SELECT item, e_hat FROM eh WHERE aspect = 'a1') e USING (item) WHERE (mi.user_id IS NULL OR coalesce(e_hat, 0) >= 0.5) AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.user_id = p.user_id AND ex.item = p.item))
  SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, item) AS rank FROM ok QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, item) <= 5""")
def constrained_recommendation(spark, d):
    """Verdicts to constraints, the pool filtered by them, ranked by score, the first five."""
    p = signal_pool(spark, d)
    verdicts = p.select("user_id", "item", F.when(F.col("n") > 2, "budget").when(F.col("r2") % 2 == 0, "complaint_aspect:a1").otherwise("price_unknown").alias("violation"))
    excluded, minima = signals.constraints_of(verdicts)
    pool = p.select("user_id", "item", F.col("n").cast("double").alias("score")).join(excluded, ["user_id", "item"], "left_anti")
    return ranked(ranking.rank_by_score(signals.reach_minima(pool, signals.item_sentiment(T.signals(spark, d)), minima), 5))


# ------------------------------------------------------------------ evaluation per row, explanations, window mode
@query(f"""WITH {S}, m0 AS (SELECT row_id, user_id, item, ts, split = 'valid' AS is_case, list(item) OVER (PARTITION BY user_id ORDER BY ts, item, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM s WHERE split IN ('train', 'valid'))
  SELECT row_id, user_id, item, len(h) AS n_history, h[-1] AS last_item FROM m0 WHERE is_case AND len(h) > 0""")
def event_cases(spark, d):
    s = save(pairs_split(spark, d), "split")
    out = protocol.event_cases(clean.part(s, "train"), clean.part(s, "valid"))
    return out.select("row_id", "user_id", "item", F.size("history").cast("long").alias("n_history"), F.element_at("history", -1).alias("last_item"))


_ROWS = f"""{S}, pop AS (SELECT item, count(*) AS c FROM tr GROUP BY 1), ord AS (SELECT item, row_number() OVER (ORDER BY c DESC, item) AS place FROM pop),
  rw AS (SELECT row_id, user_id, te.item, ts, coalesce(place, (SELECT count(*) + 1 FROM pop)) AS place FROM te LEFT JOIN ord USING (item)),
  sn AS (SELECT rw.row_id, x.item FROM rw JOIN tr x ON x.user_id = rw.user_id UNION SELECT rw.row_id, x.item FROM rw JOIN te x ON x.user_id = rw.user_id AND x.ts < rw.ts),
  rr AS (SELECT row_id, user_id, rw.item, place - (SELECT count(*) FROM sn JOIN ord USING (item) WHERE sn.row_id = rw.row_id AND ord.place < rw.place) AS rank FROM rw)"""


@query(f"WITH {_ROWS} SELECT row_id, user_id, item, rank FROM rr")
def cumulative_places(spark, d):
    """Test rows judged one by one, a user's earlier test items counting as seen: the place of each by popularity."""
    s = save(pairs_split(spark, d), "split")
    train = clean.part(s, "train")
    return protocol.unseen_places(clean.part(s, "test"), ranking.popularity(train), train, cumulative=True)


@query(f"""WITH {_ROWS}, k AS (SELECT unnest([10, 20]) AS k) SELECT 'full' AS pass, m AS metric, CAST(k AS INT) AS k, round(avg(CASE WHEN rank > k THEN 0.0::DOUBLE WHEN m = 'hr' THEN 1.0::DOUBLE WHEN m = 'ndcg' THEN 1 / log2(rank + 1) ELSE 1.0::DOUBLE / rank END), 6) AS value
  FROM rr, k, (SELECT unnest(['hr', 'ndcg', 'mrr']) AS m) GROUP BY 2, 3""")
def row_metrics(spark, d):
    s = save(pairs_split(spark, d), "split")
    train = clean.part(s, "train")
    return r6(protocol.row_metrics(protocol.unseen_places(clean.part(s, "test"), ranking.popularity(train), train, True), (10, 20), "full"), "value")


@query(f"""WITH {_ROWS}, v AS (SELECT user_id, m AS metric, CAST(k AS INT) AS k, CASE WHEN rank > k THEN 0.0::DOUBLE WHEN m = 'hr' THEN 1.0::DOUBLE WHEN m = 'ndcg' THEN 1 / log2(rank + 1) ELSE 1.0::DOUBLE / rank END AS value FROM rr, (SELECT unnest([10, 20]) AS k), (SELECT unnest(['hr', 'ndcg', 'mrr']) AS m)),
  gs AS (SELECT metric, k, user_id, count(*) AS n, avg(value) AS mean FROM v GROUP BY GROUPING SETS ((metric, k, user_id), (metric, k))), us AS (SELECT metric, k, count(*) AS n_users, avg(mean) AS user_mean FROM gs WHERE user_id IS NOT NULL GROUP BY 1, 2)
  SELECT metric, k, user_id, n, round(mean, 6) AS mean, CASE WHEN user_id IS NULL THEN n_users END AS n_users, CASE WHEN user_id IS NULL THEN round(user_mean, 6) END AS user_mean FROM gs JOIN us USING (metric, k)""")
def metric_table(spark, d):
    """Means per user, over rows and over users, of every metric, from one pass over the judged rows."""
    s = save(pairs_split(spark, d), "split")
    train = clean.part(s, "train")
    places = protocol.unseen_places(clean.part(s, "test"), ranking.popularity(train), train, True)
    wide = places.select("user_id", *metrics.single_rank_metrics(F.col("rank"), (10, 20)))
    long = wide.unpivot(["user_id"], wide.columns[1:], "name", "value")
    rows = long.select("user_id", F.split_part("name", F.lit("_"), F.lit(1)).alias("metric"), F.split_part("name", F.lit("_"), F.lit(2)).cast("int").alias("k"), "value")
    return r6(metrics.metric_table(rows), "mean", "user_mean")


@query(f"""WITH {S}, pop AS (SELECT item, count(*) AS c FROM tr GROUP BY 1), ord AS (SELECT item, row_number() OVER (ORDER BY c DESC, item) AS place FROM pop), rw AS (SELECT row_id, user_id, te.item, coalesce(place, (SELECT count(*) + 1 FROM pop)) AS place FROM te LEFT JOIN ord USING (item)),
  sn AS (SELECT DISTINCT rw.row_id, o.place AS ahead FROM rw JOIN tr USING (user_id) JOIN ord o ON o.item = tr.item WHERE o.place < rw.place), na AS (SELECT row_id, count(*) AS n FROM sn GROUP BY 1) SELECT row_id, user_id, item, place - coalesce(n, 0) AS rank FROM rw LEFT JOIN na USING (row_id)""")
def resumed_evaluation(spark, d):
    """Places of the test rows, by shards of users: a first run is stopped after two of five, a second one does the rest. As in the SQL,
    rows that share a row_id have one count of what is ahead."""
    import uuid

    from ..sources.shardlog import ShardLog

    s = save(pairs_split(spark, d), "split")
    train, test = clean.part(s, "train"), clean.part(s, "test")
    order = save(ranking.popularity(train), "popularity")
    path, config = f"{shared_dir(spark)}/logs/{uuid.uuid4().hex}", {"method": "popularity", "k": [10, 20]}
    together = save(protocol.ahead_together(test, order, train), "together")
    judge = lambda part: protocol.unseen_places(part, order, train, together=together)
    ShardLog(spark, path, config, 5).run(test, "user_id", judge, most=2)
    again = ShardLog(spark, path, config, 5)
    again.run(test, "user_id", judge)
    return again.read()


@query()
def dual_pass(spark, d):
    s = save(pairs_split(spark, d), "split")
    train = clean.part(s, "train")
    return recommend.evaluate_rows(train, clean.part(s, "test"), ranking.popularity(train), [10, 20], [1, 3, 5], 20)


_TAIL = f"""{G}, {POOL}, t0 AS (SELECT user_id, item, rank, CAST(n > 1 AND r2 % 5 = 0 AS INT) AS label, n::DOUBLE AS cat, 1.0::DOUBLE / r2 AS pop FROM pool),
  t1 AS (SELECT user_id, min(rank) FILTER (WHERE label = 1) AS best_gold, avg(cat) FILTER (WHERE rank <= 10) AS head_cat, avg(pop) FILTER (WHERE rank <= 10) AS head_pop FROM t0 GROUP BY 1),
  t2 AS (SELECT t1.*, CASE WHEN best_gold <= 10 THEN 'head' WHEN best_gold <= 300 THEN 'tail' ELSE 'beyond' END AS part, cat AS gold_cat, pop AS gold_pop FROM t1 JOIN t0 ON t0.user_id = t1.user_id AND t0.rank = best_gold)"""


def _tail(spark, d) -> DataFrame:
    p = signal_pool(spark, d)
    rows = p.select("user_id", "item", "rank", ((F.col("n") > 1) & (F.col("r2") % 5 == 0)).cast("int").alias("label"), F.col("n").cast("double").alias("cat"), (1.0 / F.col("r2")).alias("pop"))
    return protocol.tail_gold(rows, ("cat", "pop"))


@query(f"WITH {_TAIL} SELECT user_id, best_gold, part, round(gold_cat, 6) AS gold_cat, round(head_cat, 6) AS head_cat, round(gold_pop, 6) AS gold_pop, round(head_pop, 6) AS head_pop FROM t2")
def tail_gold(spark, d):
    return r6(_tail(spark, d), "gold_cat", "head_cat", "gold_pop", "head_pop")


@query(f"WITH {_TAIL} SELECT count(*) FILTER (WHERE part = 'head') AS n_head, count(*) FILTER (WHERE part = 'tail') AS n_tail, " + ", ".join(f"round(avg(gold_{c}) FILTER (WHERE part = 'tail'), 6) AS gold_{c}, round(avg(head_{c}) FILTER (WHERE part = 'tail'), 6) AS head_{c}, count(*) FILTER (WHERE part = 'tail' AND gold_{c} > head_{c}) AS above_{c}" for c in ("cat", "pop")) + " FROM t2")
def tail_report(spark, d):
    return r6(protocol.tail_report(_tail(spark, d), ("cat", "pop")), "gold_cat", "head_cat", "gold_pop", "head_pop")


@query("SELECT count(*) AS reviews, CAST(sum(turn % 3) AS BIGINT) AS model_calls, count(*) FILTER (WHERE turn % 2 = 1) AS repairs, count(*) FILTER (WHERE turn = 0) AS fast_path, round(count(*) FILTER (WHERE turn % 2 = 1) / count(*)::DOUBLE, 6) AS repair_rate, round(count(*) FILTER (WHERE turn % 2 <> 1) / count(*)::DOUBLE, 6) AS validate_only_rate, round(sum(turn % 3) / count(*)::DOUBLE, 6) AS calls_mean FROM conversations")
def call_rates(spark, d):
    rows = T.table(spark, d, "conversations").select((F.col("turn") % 3).cast("long").alias("calls"), (F.col("turn") % 2 == 1).alias("repaired"), (F.col("turn") == 0).alias("fast"))
    return r6(protocol.call_rates(rows), "repair_rate", "validate_only_rate", "calls_mean")


@query(f"""WITH {_SUI}, pt AS (SELECT user_id, item, aspect, 0.5 * weight * e_hat AS part, e_hat, n_support, weight FROM ({GI}) JOIN w USING (user_id) JOIN eh USING (item, aspect)),
  p3 AS (SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY part DESC, aspect) AS nth FROM pt QUALIFY row_number() OVER (PARTITION BY user_id, item ORDER BY part DESC, aspect) <= 3),
  lo AS (SELECT user_id, aspect, CASE WHEN polarity > 0 THEN 'positive' WHEN polarity < 0 THEN 'negative' ELSE 'neutral' END AS said FROM g QUALIFY row_number() OVER (PARTITION BY user_id, aspect ORDER BY ts DESC, row_id) = 1)
  SELECT user_id, item, count(*) AS n, string_agg(aspect, ',' ORDER BY nth) AS aspects, round(sum(part), 6) AS total, CAST(sum(n_support) AS BIGINT) AS support, string_agg('you previously expressed ' || said || ' sentiment about ' || aspect || '; This item rates ' || CASE WHEN e_hat >= 0.5 THEN 'positively' ELSE 'negatively' END || ' on ' || aspect, '|' ORDER BY nth) AS claims
  FROM p3 JOIN lo USING (user_id, aspect) GROUP BY 1, 2""")
def explanations(spark, d):
    g, base, w, e, _ = _sui(spark, d)
    out = explain.explanations(signals.contributions(base, w, e), w, e, g)
    total = lambda c: F.aggregate(f"evidence.{c}", F.lit(0.0), lambda s, x: s + x)
    claims = F.array_join(F.transform("claims", lambda c: F.regexp_replace(c, r" \(Ê=.*$", "")), "|")
    return out.select("user_id", "item", F.size("evidence").cast("long").alias("n"), F.array_join("evidence.aspect", ",").alias("aspects"), F.round(total("contribution"), 6).alias("total"), total("n_support").cast("long").alias("support"), claims.alias("claims"))


@query("""WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS item, vec_id, embedding AS e FROM embeddings), q AS (SELECT a.item AS user_id, list_transform(list_zip(a.e, coalesce(b.e, a.e)), lambda z: 0.7::DOUBLE * z[1] + 0.3::DOUBLE * z[2]) AS x FROM v a LEFT JOIN v b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 100 = 0 WHERE a.vec_id % 50 = 0),
  sc AS (SELECT user_id, item, list_sum(list_transform(list_zip(x, e), lambda z: z[1] * z[2])) AS s FROM q, v) SELECT user_id, item, round(s, 5) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(s, 12) DESC, item) <= 10""")
def aligned_full_rank(spark, d):
    """Every item for the users whose id is divisible by 50; half of them have a vector of their text."""
    from .rerank import aligned_full_rank as plan

    v = T.vectors(spark, d)
    users = v.where(F.col("item").cast("int") % 50 == 0).select(F.col("item").alias("user_id"), "vector")
    texts = v.select((F.col("item").cast("int") - 1).alias("n"), "vector").where("n % 100 = 0").select(F.col("n").cast("string").alias("user_id"), "vector")
    return plan(users, texts, v.select("item", "vector"), 10).select("user_id", "item", F.round("score", 5).alias("score"))


@query(f"WITH {G}, {POOL} SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, item) AS rank FROM pool QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, item) <= 30")
def select_pool(spark, d):
    from .rerank import select_pool as plan

    p = signal_pool(spark, d)
    return ranked(plan(p, p.select("user_id", "item", F.col("n").cast("double").alias("score")), 30))


@query(f"WITH {S.replace(', s AS (', ', s AS MATERIALIZED (', 1)}, ku AS MATERIALIZED (SELECT DISTINCT user_id FROM tr), ki AS MATERIALIZED (SELECT DISTINCT item FROM tr) SELECT row_id, s.user_id, s.item FROM s SEMI JOIN ku ON ku.user_id = s.user_id SEMI JOIN ki ON ki.item = s.item WHERE split = 'valid'")
def known_pairs(spark, d):
    """The validation pairs that a graph of the training rows can hold."""
    s = save(pairs_split(spark, d), "split")
    return graph.known_pairs(clean.part(s, "valid"), clean.part(s, "train")).select("row_id", "user_id", "item")


@query()
def context_stage(spark, d):
    """The window mode of the second stage, on counts of signals as the first."""
    from .rerank import context_stage as plan

    g = T.signals(spark, d)
    p = save(signal_pool(spark, d), "pool")
    stage1 = p.select("user_id", "item", "rank", (F.col("n") / 10.0).alias("score"))
    texts = text.category_profile(g, T.items(spark, d)).groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("category")), " ").alias("text"))
    boosts = save(covisit.coitem_scores(g, g, covisit.covisit_edges(g)), "boosts")
    return plan(stage1, boosts, p.select("user_id", "item", (1.0 / F.col("r2")).alias("phi")), texts, T.items(spark, d), {"phi": 1.0, "text": 0.25, "co": 0.1}).select("user_id", "item", "rank")


# ------------------------------------------------------------------ graphs as arrays, training batches, rounds of verdicts
def _adjacency_sql(pairs: str, nodes: str, width: int) -> str:
    return f"""pr AS ({pairs}), nd AS (SELECT unnest(range(0, ({nodes}) + 1)) AS node), pk AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, far) <= {width}),
  pl AS (SELECT node, list(far ORDER BY weight DESC, far) AS l, sum(weight) AS total, count(*) AS degree FROM pk GROUP BY 1), pe AS (SELECT node, count(*) AS edges FROM pr GROUP BY 1), pj AS (SELECT node, l, coalesce(total, 0) AS total, coalesce(degree, 0) AS degree, coalesce(edges, 0) AS edges FROM nd LEFT JOIN pl USING (node) LEFT JOIN pe USING (node))
  SELECT node, array_to_string(list_resize(coalesce(l, []), {width}, 0), ',') AS neighbours, round(total, 6) AS total, array_to_string(list_transform(range(1, {width} + 1), lambda i: CAST(i <= degree AS INT)), ',') AS mask, CAST(degree AS BIGINT) AS degree, CAST(edges - degree AS BIGINT) AS cut, CAST(sum(degree) OVER (ORDER BY node) - degree AS BIGINT) AS start FROM pj"""


_LOCAL = "im AS (SELECT item, row_number() OVER (ORDER BY item) AS local FROM (SELECT DISTINCT item FROM g))"


def _adjacency(spark, d, side: int, width: int) -> DataFrame:
    g = T.signals(spark, d)
    vocabulary = spark.createDataFrame([(f"a{n}", n) for n in range(8)], "aspect string, id int")
    out = graph.aspect_adjacency(signals.item_sentiment(g), clean.id_maps(g), vocabulary, width)[side]
    total = F.aggregate("weights", F.lit(0.0), lambda s, x: s + x)
    return out.select("node", F.array_join("neighbours", ",").alias("neighbours"), F.round(total, 6).alias("total"), F.array_join("mask", ",").alias("mask"), "degree", "cut", "start")


@query(f"WITH {G}, {SENT}, {_LOCAL}, " + _adjacency_sql("SELECT local AS node, CAST(substr(aspect, 2) AS BIGINT) + 1 AS far, abs(score) + 0.1::DOUBLE AS weight FROM e JOIN im USING (item)", "SELECT count(*) FROM im", 6))
def padded_item_aspects(spark, d):
    return _adjacency(spark, d, 0, 6)


@query(f"WITH {G}, {SENT}, {_LOCAL}, " + _adjacency_sql("SELECT CAST(substr(aspect, 2) AS BIGINT) + 1 AS node, local AS far, abs(score) + 0.1::DOUBLE AS weight FROM e JOIN im USING (item)", "SELECT 8", 40))
def padded_aspect_items(spark, d):
    return _adjacency(spark, d, 1, 40)


@query(f"""WITH {G}, {GAPS}, {_LOCAL}, ev AS (SELECT gp.user_id, local, CAST(round_even((ts - first) / scale::DOUBLE, 0) AS BIGINT) + 1 AS norm_ts, row_number() OVER (PARTITION BY gp.user_id ORDER BY ts DESC, gp.item DESC, row_id DESC) AS back FROM gp JOIN sc ON sc.user_id = gp.user_id JOIN im ON im.item = gp.item),
  st AS (SELECT *, lag(local) OVER (PARTITION BY user_id ORDER BY back) AS positive FROM ev WHERE back <= 13), sp AS (SELECT *, back - 1 AS step FROM st WHERE back > 1), ni AS (SELECT count(*) AS n FROM im), sn AS (SELECT DISTINCT user_id, local FROM ev), fu AS (SELECT user_id FROM sn, ni GROUP BY user_id, n HAVING count(*) >= n),
  dr AS (SELECT user_id, step, j, 1 + ('0x' || substr(md5('42:3:' || user_id || ':' || step || ':' || j), 1, 8))::BIGINT % n AS local FROM sp, ni, range(0, 508) t(j) WHERE user_id NOT IN (SELECT user_id FROM fu)), ng AS (SELECT user_id, step, min_by(local, j) AS negative FROM dr ANTI JOIN sn USING (user_id, local) GROUP BY 1, 2),
  ls AS (SELECT user_id, list(local ORDER BY step DESC) AS s, list(norm_ts ORDER BY step DESC) AS t, list(positive ORDER BY step DESC) AS p, list(coalesce(negative, 0) ORDER BY step DESC) AS q FROM sp LEFT JOIN ng USING (user_id, step) GROUP BY 1),
  od AS (SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5('42:3:' || user_id), 1, 8))::BIGINT, user_id) - 1 AS place FROM ls)
  SELECT place // 16 AS batch, place % 16 AS nth, user_id, """ + ", ".join(f"array_to_string(list_concat(list_transform(range(0, 12 - len({c})), lambda i: 0), {c}), ',') AS {n}" for c, n in (("s", "seq"), ("t", "times"), ("p", "positive"), ("q", "negative"))) + " FROM od")
def training_batches(spark, d):
    """The third epoch's batches of 16 users, sequences of 12."""
    g = T.signals(spark, d)
    out = training.training_batches(g, clean.id_maps(g), 12, 16, epoch=3)
    return out.select("batch", "nth", "user_id", *(F.array_join(c, ",").alias(c) for c in ("seq", "times", "positive", "negative")))


@query(f"""WITH {G}, {POOL}, lo AS (SELECT user_id, list(item ORDER BY rank) AS o, list(item ORDER BY r2) AS f, CAST(user_id AS INT) % 7 = 0 AS failed FROM pool GROUP BY 1), l0 AS (SELECT *, list_filter(o[1:3], lambda x: CAST(x AS INT) % 5 = 0) AS b0 FROM lo),
  l1 AS (SELECT *, list_concat(list_filter(o, lambda x: NOT list_contains(b0, x)), b0) AS o1 FROM l0), l2 AS (SELECT *, list_filter(o1[1:3], lambda x: CAST(x AS INT) % 5 = 0) AS b1 FROM l1), l3 AS (SELECT *, list_concat(list_filter(o1, lambda x: NOT list_contains(b1, x)), b1) AS o2 FROM l2), l4 AS (SELECT *, list_filter(o2[1:3], lambda x: CAST(x AS INT) % 5 = 0) AS b2 FROM l3)
  SELECT user_id, CASE WHEN failed OR len(b0) = 0 THEN 1 WHEN len(b1) = 0 THEN 2 ELSE 3 END AS rounds, CASE WHEN failed THEN 'fallback' WHEN len(b0) = 0 OR len(b1) = 0 OR len(b2) = 0 THEN 'approved' ELSE 'exhausted' END AS state, CASE WHEN failed THEN 'timeout' END AS error,
    array_to_string(CASE WHEN failed THEN f WHEN len(b0) = 0 THEN o WHEN len(b1) = 0 THEN o1 ELSE o2 END, ',') AS list FROM l4""")
def verdict_rounds(spark, d):
    """Users' lists are judged by their first three items and repaired in rounds; some fail and get another list."""
    p = save(signal_pool(spark, d), "pool")
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.struct(c, "item"))), lambda x: x["item"])
    rows = p.groupBy("user_id").agg(listed("rank").alias("own"), listed("r2").alias("other"))
    bad = F.filter(F.slice("list", 1, 3), lambda x: x.cast("int") % 5 == 0)
    none = F.lit(None).cast("string").alias("error")
    answer = lambda r: r.select("user_id", F.col("own").alias("list"), F.when(F.col("user_id").cast("int") % 7 == 0, "timeout").alias("error"))
    judge = lambda a: a.select("user_id", (F.size(bad) == 0).alias("approved"), F.when(F.size(bad) > 0, bad).alias("hint"))
    repair = lambda r: r.select("user_id", F.concat(F.filter("list", lambda x: ~F.array_contains("hint", x)), "hint").alias("list"), none)
    fallback = lambda r: r.select("user_id", F.col("other").alias("list"), none)
    results, states = rounds.run_rounds(rows, "user_id", answer, judge, repair, fallback, budget=3)
    return rounds.last_states(states, "user_id").join(results.select("user_id", F.array_join("list", ",").alias("list")), "user_id")
