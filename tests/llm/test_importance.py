import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from reviewlake.llm import importance as R
from reviewlake.llm.queries import ORACLE_SQL, QUERIES

from ..compare import connect, difference

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 97} X{i % 1013}" for i in range(150_000))
CASES = [(1, "a b a B, c"), (2, None), (3, ""), (4, " .,;\n"), (5, LONG), (6, "é É ñ x 42a"), (7, "a b c d e"), (7, "a b c d e"), (None, "b c d e f"), (9, "a[b]c{d}e~f"), (10, "z z z z z z")]
TARGET = [(1, "a b c"), (2, None), (3, "a b é 42a")]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, target, longest, buckets, least, percent, seed):
    grams = lambda t: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for w in [words(t)] for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    s, t = Counter(b for _, x in rows for b in grams(x)), Counter(b for _, x in target for b in grams(x))
    ns, nt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in s}
    out = []
    for i, x in rows:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        g = grams(x)
        weight = sum(gain[b] for b in g)
        out.append([i, len(words(x)), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = k
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("longest, buckets, least, percent, cell_rows", [(1, 10_000, 5, 50, 2), (3, 97, 2, 34, 1), (4, 10_000, 0, 100, 4096), (2, 5, 20, 10, 1)])
def test_same_as_brute_force(spark, longest, buckets, least, percent, cell_rows):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in CASES], "doc_id long, text string, score int, bucket string")
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    got = [tuple(r) for r in R.resample(df, target, longest, buckets, least, percent, 7, cell_rows=cell_rows).collect()]
    assert sorted(got, key=str) == brute(CASES, TARGET, longest, buckets, least, percent, 7)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(CASES, "doc_id long, text string")
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert R.resample(none, nothing).count() == 0
    assert sorted((tuple(r) for r in R.resample(some, nothing, least_words=5).collect()), key=str) == brute(CASES, [], 1, 10_000, 5, 10, 2024)


def test_hot_rows_get_ranks_of_their_own(spark):
    rows = [(5, "a b c")] * 60 + [(i, f"a {i} c") for i in range(40)] + [(None, "a b c")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = [tuple(r) for r in R.resample(df, spark.createDataFrame(TARGET, "item_id long, text string"), least_words=1, percent=60, cell_rows=8).collect()]
    assert sorted(r[5] for r in got if r[5]) == list(range(1, 79))
    assert sorted(got, key=str) == brute(rows, TARGET, 1, 10_000, 1, 60, 2024)


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 8])
def test_suffix_array_and_common_prefixes(depth):
    draw = np.random.default_rng(depth)
    edge = np.array([0, 0, 40, 41, 300, 300])
    ids, ends = draw.integers(0, 3, 300), np.repeat(edge[1:], np.diff(edge))
    order = R.suffix_array(ids, ends, depth)
    cut = lambda i: tuple(ids[i : min(ends[i], i + depth)])
    assert sorted(order) == list(range(300)) and [cut(i) for i in order] == sorted(cut(i) for i in range(300))
    shared = R.common_prefixes(ids, ends, order, depth)
    for a, b, n in zip(order, order[1:], shared[1:]):
        x, y = cut(a), cut(b)
        assert n == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
    assert len(R.suffix_array(ids[:0], ends[:0], depth)) == 0


def test_query_like_sql_and_brute_force(spark):
    name = "op12_importance_resampling"
    assert difference(spark, connect(SF), SF, QUERIES[name], ORACLE_SQL[name]) is None
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [(r[0], *r[2:]) for r in brute(rows, target, 1, 10_000, 20, 10, 2024)]
    assert sorted((tuple(r) for r in QUERIES[name](spark, SF).collect()), key=str) == sorted(want, key=str)
