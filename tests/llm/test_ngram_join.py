import random
import re

import duckdb
import numpy as np
import pytest

from reviewlake.llm import ngram_join
from reviewlake.llm import queries as Q
from reviewlake.llm.common import narrow, parted
from reviewlake.llm.kernels import mix
from reviewlake.llm.ngram_join import bands_of, close_pairs, ngram_jaccard, signatures, sketch_of

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    to = {i: i for i, _ in rows if i is not None}

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 75 * len(a | b):
                p, q = root(i), root(j)
                to[max(p, q)] = min(p, q)
    return sorted(((i, len(a), None if i is None else root(i)) for i, a in sets), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(40)]
    rows = [(1000, "one two"), (1001, "One  TWO"), (1002, None), (1003, " \t"), (1004, "É é é é é x"), (None, "one two"), (1005, "a a a a a a a a a"), (1006, "a a a a a"), (1001, "one two three four five six seven")]
    for i in range(n):
        kind = rng.random()
        if kind < 0.4 or i < 5:
            words = [word() for _ in range(rng.randint(5, 120))]
        elif kind < 0.7:  # a shared passage among words of its own
            words = [word() for _ in range(rng.randint(10, 70))]
            k = rng.randrange(len(words))
            words = words[:k] + passage + words[k:]
        else:  # edits of another text, around the limit
            words = (rng.choice(rows[9:])[1] or "x y z").split()
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = word()
            words += [word() for _ in range(rng.choice([0, 0, 1, 3, 8]))]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("seed", "n", "hot"), [(1, 200, 1024), (2, 200, 4)])
def test_against_brute_force(spark, seed, n, hot):
    rows = corpus(seed, n)
    df = spark.createDataFrame([(i, t, 7, "s") for i, t in rows], "doc_id long, text string, id long, sig string")
    got = sorted((tuple(r) for r in ngram_jaccard(df, hot=hot).collect()), key=str)
    assert got == brute(rows)


def test_pigeonhole():
    """Of two sets that are similar enough, one shows a signature of the other, also without hot ones that both have."""
    rng = np.random.default_rng(3)
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        a = mix(rng.integers(0, 2**63, n).astype(np.uint64))
        keep = int(rng.integers(max(1, int(0.7 * n)), n + 1))
        b = np.unique(np.concatenate([a[:keep], mix(rng.integers(0, 2**63, int(rng.integers(0, n // 3 + 1))).astype(np.uint64))]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        bands = set(bands_of(len(a), 75)) & set(bands_of(len(b), 75))
        shown = [(signatures(a, k, 75), signatures(b, k, 75)) for k in bands]
        assert all(x[1] and y[1] for x, y in shown)
        assert any(len(np.intersect1d(x[0], y[0])) for x, y in shown)
        for k in bands:
            hot = np.sort(rng.choice(np.concatenate([signatures(a, k, 75)[0], signatures(b, k, 75)[0]]), 2))
            x, y = signatures(a, k, 75, hot), signatures(b, k, 75, hot)
            if len(bands) == 1 and x[1] and y[1]:
                assert len(np.setdiff1d(np.intersect1d(x[0], y[0]), hot))


def test_sketches():
    """Sketches differ in no more bits than the sets in tokens, also of different sizes."""
    rng = np.random.default_rng(5)
    for n in (1, 10, 900, 1000, 1020, 1030, 2500, 40_000):
        a = np.unique(mix(rng.integers(0, 2**63, n).astype(np.uint64)))
        b = np.unique(np.concatenate([a[: int(0.9 * n)], mix(rng.integers(0, 2**63, n // 5).astype(np.uint64))]))
        x, y = sorted((sketch_of(a), sketch_of(b)), key=len)
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        apart = np.unpackbits((x ^ y).view(np.uint8)).sum()
        assert apart <= len(np.setxor1d(a, b)) and (n < 1000 or apart > 0.6 * len(np.setxor1d(a, b)))


def test_close_pairs():
    rng = np.random.default_rng(7)
    base = mix(rng.integers(0, 2**63, 2000).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[: rng.integers(900, 1500)], mix(rng.integers(0, 2**63, rng.integers(0, 300)).astype(np.uint64))])) for _ in range(40)]
    ids, labels = np.arange(40)[::-1].copy(), np.arange(40) % 3
    a, b = close_pairs(ids, labels, np.array([len(x) for x in sets]), [sketch_of(x) for x in sets], 75)
    got = set(zip(a.tolist(), b.tolist()))
    assert len(got) == len(a)
    for i in range(40):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if labels[i] != labels[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                assert (min(ids[i], ids[j]), max(ids[i], ids[j])) in got
            elif labels[i] == labels[j]:
                assert (min(ids[i], ids[j]), max(ids[i], ids[j])) not in got


def test_great_groups_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TOGETHER", 16)
    rng = np.random.default_rng(11)
    base = mix(rng.integers(0, 2**63, 3000).astype(np.uint64))
    sizes = rng.integers(300, 2900, 150)
    sets = [np.unique(np.concatenate([base[:n], mix(rng.integers(0, 2**63, n // 20).astype(np.uint64))])) for n in sizes]
    label = {i: (0 if i % 3 else i) for i in range(150)}
    rows = spark.createDataFrame([(i, len(x), sketch_of(x).tolist()) for i, x in enumerate(sets)], "doc_id long, n_shingles long, sketch array<long>")
    groups = spark.createDataFrame([(7, i) for i in range(150)] + [(8, i) for i in range(0, 30, 3)] + [(9, 1), (9, 2)], "g long, id long")
    labels = spark.createDataFrame([(i, c) for i, c in label.items() if i % 2], "node long, component long")
    got = {(r.a, r.b) for r in ngram_join._across(groups, labels, rows, 75).collect()}
    at = {i: c if i % 2 else i for i, c in label.items()}
    for i in range(150):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if at[i] != at[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                assert (j, i) in got
    assert all(at[a] != at[b] for a, b in got)
    own = rows.select(rows.doc_id.alias("id"), "n_shingles", "sketch")
    dealt = ngram_join._dealt(ngram_join._apart_groups(groups, labels), own, 75)
    assert max(r["count"] for r in dealt.groupBy("g").count().collect()) <= 40


def test_narrow(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    some = rows.where("doc_id % 7 = 0")
    got = {r.doc_id for r in narrow(rows, some).collect()}
    assert {r.doc_id for r in some.collect()} <= got and len(got) < 3100
    maybe, never = parted(rows.union(spark.sql("select cast(null as bigint)")), some, "doc_id")
    assert {r.doc_id for r in maybe.collect()} == got and never.count() == 20_001 - len(got)
    assert parted(rows, some.where("false"), "doc_id")[1].count() == 20_000


def test_empty(spark):
    assert ngram_jaccard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ngram_join_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(Q.ORACLE_SQL["op7_ngram_jaccard"]).fetchall()
    got = Q.op7_ngram_jaccard(spark, SF).select("doc_id", "n_shingles", "component_id")
    assert sorted(want) == sorted(map(tuple, got.collect()))
