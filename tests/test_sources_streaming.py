import json
import math

import pytest
from pyspark.sql import functions as F

from reviewlake.functions.columns import DAY_US
from reviewlake.operators import clean, signals
from reviewlake.sources import readers, sinks
from reviewlake.streaming import decay


def write(path, *lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def test_reviews(spark, tmp_path):
    p = write(
        tmp_path / "r.jsonl",
        {"user_id": "u1", "parent_asin": "", "asin": "A1", "rating": 4, "timestamp": 5, "text": "hi", "verified_purchase": True},
        "", "{broken", "[1]",
        {"user_id": "u2", "business_id": "b1", "stars": 3, "date": "2016-03-09 12:30:00", "useful": 2, "text": "ok", "review_id": "x"},
        {"user_id": "u3", "business_id": "b1", "stars": 3, "date": "2016-03-09"},
        {"user_id": "", "asin": "A1", "rating": 4, "timestamp": 5}, {"user_id": "u", "asin": "A1", "timestamp": 5},
    )
    got = {r.user_id: r for r in readers.read_reviews(spark, p).collect()}
    assert set(got) == {"u1", "u2", "u3"}
    assert (got["u1"].item, got["u1"].ts, got["u1"].verified, got["u1"].review_id) == ("A1", 5000, True, "u1|A1|5")
    assert (got["u2"].ts, got["u2"].helpful_vote, got["u2"].review_id, got["u3"].ts) == (1457526600000000, 2, "x", 1457481600000000)
    assert readers.interactions(readers.read_reviews(spark, p), 2).count() == 2


def test_typed_tsv(spark, tmp_path):
    p = write(tmp_path / "x.inter", "user_id:token\titem_id:token\trating:float\ttimestamp:float", "u\ti\t4\t1546264800", "u\tj\tbad\t1546264801", "u\tk\t5\t1", "v\ti\t1\t1577714400")
    got = readers.read_typed_interactions(spark, p, 1546264800, 1577714400)
    assert sorted((r.user_id, r.item, r.ts) for r in got.collect()) == [("u", "i", 1546264800000000), ("v", "i", 1577714400000000)]
    with pytest.raises(ValueError):
        readers.typed_header("a:token\t:float")


def test_meta(spark, tmp_path):
    p = write(tmp_path / "m.jsonl", {"parent_asin": "B1", "title": "one", "categories": ["X", "Y", "X"]}, {"parent_asin": "B1", "title": "two", "main_category": "M"}, {"asin": "B2", "title": "z"})
    last = {r.item: (r.name, r.categories) for r in readers.read_meta(spark, p).collect()}
    first = {r.item: r.name for r in readers.read_meta(spark, p, spark.createDataFrame([("B1",)], "item string")).collect()}
    assert last == {"B1": ("two", "M"), "B2": ("z", "")} and first == {"B1": "one"}
    b = write(tmp_path / "b.jsonl", {"business_id": "b1", "name": "N", "city": "Philadelphia", "categories": "Restaurants, Bars"}, {"business_id": "b2", "city": "Reno", "categories": "Restaurants"})
    venues = readers.business_meta(readers.json_lines(spark, b, readers.BUSINESS))
    assert [r.item for r in sinks.select_businesses(venues, ["philadelphia"], ["restaurant"]).collect()] == ["b1"]


def test_triples_to_signals(spark, tmp_path):
    p = write(tmp_path / "t.jsonl", {"review_id": "r1", "triples": [{"aspect": "Smell", "opinion": "great", "sentiment": "positive", "confidence": 0.9}]}, {"review_id": "r2", "triples": []})
    index = spark.createDataFrame([("r1", "u1", "i1", 7), ("r2", "u1", "i2", 8)], "review_id string, user_id string, item string, ts long")
    votes = spark.createDataFrame([("u1", "i1", 7, 3)], "user_id string, item string, ts long, helpful_vote int")
    got = readers.signals_from_triples(index, readers.read_triples(spark, p), votes).collect()
    assert [(r.item, r.aspect, r.polarity, r.helpful) for r in got] == [("i1", "scent", 1.0, 3)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("u", f"i{n}", n, 1.0, 0, True, n) for n in range(10)], "user_id string, item string, ts long, rating double, helpful_vote int, verified boolean, row_id long")
    manifest = sinks.write_split(clean.chronological_split(rows), str(tmp_path / "s"))
    assert {r.split: r.n_rows for r in manifest.collect()} == {"train": 8, "valid": 1, "test": 1}
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 3)], "k int, v string, row_id int")
    assert sorted(map(tuple, sinks.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, sinks.merged_shards(old, spark.createDataFrame([(2, "c"), (3, "e")], "k int, v string"), ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "e")]
    path = f"file://{tmp_path}/cache"
    sinks.check_version(spark, path, "v1")
    sinks.check_version(spark, path, "v1")
    with pytest.raises(ValueError):
        sinks.check_version(spark, path, "v2")
    a, b = sinks.fingerprint(rows).first(), sinks.fingerprint(rows.repartition(5)).first()
    assert a == b and sinks.duplicate_keys(rows, ["user_id"]).first().n == 10
    sinks.write_typed_tsv(clean.chronological_split(rows), str(tmp_path / "tsv"))
    assert spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "tsv")).count() == 10


def test_streamed_interest_equals_batch(spark, tmp_path):
    made = [("u", "a", 1.0, 5 * DAY_US), ("u", "a", -0.5, 2 * DAY_US), ("u", "b", 0.25, 3 * DAY_US), ("v", "a", 1.0, 1), ("u", "a", 0.5, 9 * DAY_US)]
    schema = "user_id string, aspect string, polarity double, ts long"
    for n, part in enumerate((made[:2], made[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/data/in{n}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/data")
    q = decay.decayed_interest(stream, 0.05).writeStream.outputMode("update").format("memory").queryName("interest").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    last = {(r.user_id, r.aspect): r for r in spark.sql("select user_id, aspect, max_by(struct(interest, gamma), ts) as s, max(ts) as ts from interest group by 1, 2").collect()}
    # The memory sink keeps each update; of updates at one time the last one has the most events, so the greatest interest.
    best = {(r.user_id, r.aspect): r.i for r in spark.sql("select user_id, aspect, max(struct(ts, interest)).interest as i from interest group by 1, 2").collect()}
    at = 10 * DAY_US
    batch = signals.interest_scores(spark.createDataFrame(made, schema), spark.createDataFrame([("u", at), ("v", at)], "user_id string, query_ts long"), 0.05)
    for r in batch.collect():
        key = (r.user_id, r.aspect)
        assert abs(best[key] * math.exp(-0.05 * (at - last[key].ts) / DAY_US) - r.interest) < 1e-9


def test_windows(spark, tmp_path):
    spark.sql("select 'u' as user_id, 'a' as aspect, 1.0D as polarity, timestamp'2024-01-01 00:00:00' as event_time union all select 'u', 'a', 0.0D, timestamp'2024-01-01 00:10:00' union all select 'u', 'a', 0.5D, timestamp'2024-01-05 00:00:00'").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("user_id string, aspect string, polarity double, event_time timestamp").parquet(f"{tmp_path}/in")
    for name, df in (("counts", decay.aspect_counts(stream)), ("runs", decay.sessions(stream)), ("firsts", decay.first_events(stream, ["user_id", "aspect"]))):
        q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    assert [r.n for r in spark.table("counts").collect()] == [2] and [r.n for r in spark.table("runs").collect()] == [2]
    assert spark.table("firsts").count() == 1
    assert spark.table("counts").select(F.avg("polarity")).first()[0] == 0.5


def _push(spark, path, n, rows):
    spark.createDataFrame(rows, "user_id string, aspect string, polarity double, ts long").coalesce(1).write.parquet(f"{path}/data/in{n}")


def _interest(spark, path, out, **options):
    stream = spark.readStream.schema("user_id string, aspect string, polarity double, ts long").option("recursiveFileLookup", "true").parquet(f"{path}/data")

    def keep(batch, n):
        out.extend((r.user_id, r.aspect, round(r.interest, 9), r.ts) for r in batch.collect())

    return decay.decayed_interest(stream, 0.05, **options).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/cp")


def test_interest_goes_on_after_a_restart(spark, tmp_path):
    first, second = [], []
    _push(spark, tmp_path, 0, [("u", "a", 1.0, 0)])
    _interest(spark, tmp_path, first).trigger(availableNow=True).start().awaitTermination()
    _push(spark, tmp_path, 1, [("u", "a", 1.0, 2 * DAY_US), ("u", "a", -1.0, DAY_US), ("w", "a", 0.5, 7)])
    _interest(spark, tmp_path, second).trigger(availableNow=True).start().awaitTermination()
    assert first == [("u", "a", 1.0, 0)]
    assert sorted(second) == [("u", "a", round(1 + math.exp(-0.05) + math.exp(-0.1), 9), 2 * DAY_US), ("w", "a", 0.5, 7)]


def test_idle_interest_expires(spark, tmp_path):
    import time

    out = []
    _push(spark, tmp_path, 0, [("u", "a", 1.0, 0), ("v", "a", 1.0, 0)])
    q = _interest(spark, tmp_path, out, idle_ms=3000).trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 90
        while time.time() < end and sum(r[3] is None for r in out) < 2:
            time.sleep(0.3)
        assert sorted(out, key=str) == sorted([("u", "a", 1.0, 0), ("v", "a", 1.0, 0), ("u", "a", 0.0, None), ("v", "a", 0.0, None)], key=str)
        _push(spark, tmp_path, 1, [("u", "a", 0.5, DAY_US)])
        while time.time() < end and ("u", "a", 0.5, DAY_US) not in out:
            time.sleep(0.3)
        assert ("u", "a", 0.5, DAY_US) in out  # anew, nothing of the first event is left
    finally:
        q.stop()


def test_aspects_of_a_user_expire_apart(spark, tmp_path):
    import time

    out = []
    _push(spark, tmp_path, 0, [("u", "a", 1.0, 0), ("u", "b", -1.0, 0)])
    q = _interest(spark, tmp_path, out, idle_ms=6000).trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 90
        while time.time() < end and not out:
            time.sleep(0.2)
        _push(spark, tmp_path, 1, [("u", "a", 0.5, DAY_US)])
        while time.time() < end and ("u", "b", 0.0, None) not in out:
            time.sleep(0.2)
        while time.time() < end and ("u", "a", 0.0, None) not in out:
            time.sleep(0.2)
    finally:
        q.stop()
    assert sorted(out[:2]) == [("u", "a", 1.0, 0), ("u", "b", 1.0, 0)] and out[2] == ("u", "a", round(0.5 + math.exp(-0.05), 9), DAY_US)
    assert out[3:] == [("u", "b", 0.0, None), ("u", "a", 0.0, None)]


def test_updates_write_one_state_per_user(spark, tmp_path):
    _push(spark, tmp_path, 0, [("u", a, 1.0, 0) for a in "abcdefgh"] + [("v", "a", 1.0, 0)])
    q = _interest(spark, tmp_path, []).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(s.numRowsUpdated for p in q.recentProgress for s in p.stateOperators) == 2


def test_targets_to_try_again_and_vectors_held_against_a_manifest(spark, tmp_path):
    import pytest

    from reviewlake.sources import readers

    spark.createDataFrame([("1", "a"), ("2", "b"), ("3", " "), ("4", "d")], "review_id string, text string").write.json(f"{tmp_path}/targets")
    some = lambda *x: spark.createDataFrame([(i,) for i in x], "review_id string")
    ids = lambda df: sorted(r.review_id for r in df.collect())
    assert ids(readers.read_targets(spark, f"{tmp_path}/targets")) == ["1", "2", "4"]
    assert ids(readers.read_targets(spark, f"{tmp_path}/targets", some("1", "4", "4", "9"))) == ["1", "4"]
    assert ids(readers.read_targets(spark, f"{tmp_path}/targets", errors=some("2", "4"), done=some("4"))) == ["2"]
    edges = spark.createDataFrame([("a", "b", 2), ("a", "c", 1), ('x"y', "a", 3)], "anchor string, co string, n long")
    assert sorted(map(tuple, readers.covisit_from_json(readers.covisit_to_json(edges)).collect())) == sorted(map(tuple, edges.collect()))
    spark.createDataFrame([("user", "u", [1.0, 2.0]), ("item", "i", [1.0]), ("item", "j", [2.0])], "kind string, key string, vector array<float>").write.parquet(f"{tmp_path}/v")
    assert readers.read_vectors(spark, f"{tmp_path}/v", {"user": 2, "item": 1}).count() == 3
    for bad in ({"user": 2}, {"user": 2, "item": 2}, {"user": 2, "item": 1, "aspect": 1}):
        with pytest.raises(ValueError):
            readers.read_vectors(spark, f"{tmp_path}/v", bad)
