import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from reviewlake.llm import queries as Q
from reviewlake.llm import topk_search
from reviewlake.llm.kernels import flat, word_hashes
from reviewlake.llm.topk_search import search


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, queries, k):
    rows = [(i, Counter(words(t))) for i, t in docs if i is not None]
    n, mean = len(rows), sum(sum(c.values()) for _, c in rows) / max(1, len(rows))
    df = Counter(w for _, c in rows for w in c)
    asked = {}
    for i, t in queries:
        if i is not None:
            asked[i] = min(asked.get(i, t or ""), t or "")
    out = []
    for q, t in asked.items():
        scored = []
        for i, c in rows:
            s = sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, m in Counter(words(t)).items() if c[w])
            if s > 0:
                scored.append((-round(s, 9), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_DOCS", 1024)  # shards close between slices of documents
    rng = random.Random(seed)
    vocabulary = [f"w{int(1000 * rng.random() ** 3)}" for _ in range(3000)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 20, 60, 300])))) for i in range(700)]
    docs += [(701, None), (702, ""), (703, docs[0][1]), (None, "w1 w2"), (50, "W1 w1 w1"), (704, " \t"), (705, "w1 " * 70_000), (706, "É é")]
    queries = [d for d in docs if d[0] is None or d[0] % 25 == 0] + [(9000, ""), (9001, "nowhere"), (9002, "w0 w1"), (9003, "É"), (9004, None)]
    make = lambda rows: spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, rank int, term string")
    got = [tuple(r) for r in search(make(docs).repartition(3), make(queries), k=7).collect()]
    want = brute(docs, queries, 7)
    assert sorted((q, r, i) for q, r, i, _ in got) == [(q, r, i) for q, r, i, _ in want]
    assert max(abs(a[3] - b[3]) for a, b in zip(sorted(got), want)) < 1e-8


def test_blocks_are_skipped():
    rng = np.random.default_rng(3)
    n, k = 4096, 5
    texts = [" ".join(f"c{x}" for x in rng.integers(0, 40, 30)) + (f" r{i // 512} r{i // 512}" if i % 512 < 20 else "") for i in range(n)]
    data, at = flat(pa.array(texts))
    term, doc, tf, length = topk_search.term_counts(data, at)
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    df = np.diff(np.r_[first, len(term)])
    ids = np.arange(n)[::-1].copy()
    mean = length.mean()
    shard = topk_search.Shard(topk_search.packed(term[first], df.astype(np.uint16)), topk_search.packed(doc.astype(np.uint16), tf.astype(np.uint32), length.astype(np.uint32), ids), mean)
    asked = np.unique(word_hashes(*flat(pa.array(["r3 r5 c1 c2"])))[0])
    own = np.searchsorted(shard.terms, asked)
    weights = np.log(1 + (n - df[own] + 0.5) / (df[own] + 0.5))
    bound = shard.bounds(np.zeros(len(own), np.int64), own, weights, 1)[0]
    got = shard.search(own, weights, bound, k, (np.zeros(0, np.int64), np.zeros(0)))
    dense = np.zeros(n)
    for t, w in zip(own, weights):
        s = slice(first[t], first[t] + df[t])
        dense[doc[s]] += w * tf[s] * 2.2 / (tf[s] + 1.2 * (0.25 + 0.75 * length[doc[s]] / mean))
    want = np.lexsort((ids, -dense.round(9)))[:k]
    assert got[0].tolist() == ids[want].tolist() and np.allclose(got[1], dense[want])
    assert (bound.repeat(np.diff(shard.edge)) >= dense).all() and shard.n_blocks < n / 4
    assert shard.skipped > 4 * shard.scored > 0
    # What another shard has found raises the bar, down to scoring nothing.
    shard.scored = shard.skipped = 0
    high = (np.arange(k), np.full(k, 1e9))
    assert shard.search(own, weights, bound, k, high)[1].tolist() == [1e9] * k and shard.scored == 0 and shard.skipped == shard.n_blocks


def test_long_documents_give_a_floor():
    # Long and short texts by turns: a search that begins without a floor scores few more blocks than it returns (212 of 20 x 2,986).
    rng = np.random.default_rng(5)
    n, k = 3000, 10
    texts = [" ".join(f"w{x}" for x in (6000 * rng.random(int(rng.integers(300, 600) if i % 2 else rng.integers(20, 60))) ** 3).astype(int)) for i in range(n)]
    term, doc, tf, length = topk_search.term_counts(*flat(pa.array(texts)))
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    df = np.diff(np.r_[first, len(term)])
    ids, mean = np.arange(n), length.mean()
    shard = topk_search.Shard(topk_search.packed(term[first], df.astype(np.uint16)), topk_search.packed(doc.astype(np.uint16), tf.astype(np.uint32), length.astype(np.uint32), ids), mean)
    asked = range(0, 100, 5)
    cells = [np.flatnonzero(doc == q) for q in asked]
    own = np.searchsorted(first, np.concatenate(cells), "right") - 1
    ends = np.r_[0, np.cumsum([len(c) for c in cells])]
    weights = tf[np.concatenate(cells)] * np.log(1 + (n - df[own] + 0.5) / (df[own] + 0.5))
    bound = shard.bounds(np.repeat(np.arange(len(asked)), np.diff(ends)), own, weights, len(asked))
    got = []
    for q, (i, j) in enumerate(zip(ends[:-1], ends[1:])):
        got.append(shard.search(own[i:j], weights[i:j], bound[q], k, (np.zeros(0, np.int64), np.zeros(0))))
        dense = np.zeros(n)
        for t, w in zip(own[i:j], weights[i:j]):
            s = slice(first[t], first[t] + df[t])
            dense[doc[s]] += w * tf[s] * 2.2 / (tf[s] + 1.2 * (0.25 + 0.75 * length[doc[s]] / mean))
        want = np.lexsort((ids, -dense.round(9)))[:k]
        assert got[q][0].tolist() == ids[want].tolist() and np.allclose(got[q][1], dense[want])
    assert shard.scored < 2 * k * len(asked)
    # Many queries at once have the results of each alone, in passes of any size.
    for size in (1, 1 << 18):
        topk_search.SCORED, held = size, topk_search.SCORED
        every = shard.search_all(own, weights, ends, bound, k, [(np.zeros(0, np.int64), np.zeros(0))] * len(asked), np.zeros(len(asked)))
        topk_search.SCORED = held
        assert all(a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist() for a, b in zip(every, got))


def test_queries_in_several_blocks(spark, monkeypatch):
    rng = random.Random(7)
    docs = [(i, " ".join(f"w{int(200 * rng.random() ** 2)}" for _ in range(40))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(topk_search, "QUERY_BYTES", 3000)
    got = [tuple(r) for r in search(df, df.where("doc_id % 10 = 0"), k=4).collect()]
    want = brute(docs, [d for d in docs if d[0] % 10 == 0], 4)
    assert sorted((q, r, i) for q, r, i, _ in got) == [(q, r, i) for q, r, i, _ in want]


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert search(none, some).count() == 0 and search(some, none).count() == 0


def test_same_rows_as_sql(spark):
    from tests.compare import connect, difference

    sf = "/root/testdata/sf0.001"
    assert difference(spark, connect(sf), sf, Q.op1_bm25_search, Q.ORACLE_SQL["op1_bm25_search"]) is None


def two_languages(n, seed):
    rng = np.random.default_rng(seed)
    words = [" ".join(f"{'ab'[i % 2]}{x}" for x in (1500 * rng.random(int(rng.integers(20, 200))) ** 2).astype(int)) + " both" for i in range(n)]
    return list(enumerate(words))


def test_kinds_meet_little():
    # Languages by turns: a query's product of matrices has the blocks of its own language only, each with its own frequent terms.
    docs, k = two_languages(1400, 11), 5
    term, doc, tf, length = topk_search.term_counts(*flat(pa.array([t for _, t in docs])))
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    nr = np.searchsorted(first, np.arange(len(term)), "right") - 1
    found = topk_search.kinds(nr, doc, len(docs))
    assert sorted(len(set(x % 2)) for x in found) == [1] * len(found) and len(found) > 1
    assert sorted(np.concatenate(found).tolist()) == list(range(len(docs)))
    own = np.concatenate(found)
    rank = np.argsort(own)
    order = np.lexsort((rank[doc], nr))
    ends = np.cumsum([0] + [len(x) for x in found[:-1]])
    df = np.diff(np.r_[first, len(term)])
    postings = topk_search.packed(rank[doc][order].astype(np.uint16), tf[order].astype(np.uint32), length[own].astype(np.uint32), own)
    shard = topk_search.Shard(topk_search.packed(term[first], df.astype(np.uint16)), postings, length.mean(), ends.tolist())
    assert sum(m.size for m in shard.maxima) < 0.6 * max(len(m) for m in shard.maxima) * len(found) * shard.n_blocks
    asked = range(0, 300, 3)
    cells = [np.flatnonzero(doc == q) for q in asked]
    at, query = nr[np.concatenate(cells)], np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    weights = tf[np.concatenate(cells)] * np.log(1 + (len(docs) - df[at] + 0.5) / (df[at] + 0.5))
    bound = shard.bounds(query, at, weights, len(cells))
    got = shard.search_all(at, weights, np.searchsorted(query, np.arange(len(cells) + 1)), bound, k, [(np.zeros(0, np.int64), np.zeros(0))] * len(cells), np.zeros(len(cells)))
    for q in range(len(cells)):
        dense = np.zeros(len(docs))
        for t, w in zip(at[query == q], weights[query == q]):
            s = slice(first[t], first[t] + df[t])
            dense[doc[s]] += w * tf[s] * 2.2 / (tf[s] + 1.2 * (0.25 + 0.75 * length[doc[s]] / length.mean()))
        want = np.lexsort((np.arange(len(docs)), -dense.round(9)))[:k]
        assert got[q][0].tolist() == want.tolist() and (bound[q].repeat(np.diff(shard.edge)) >= dense[own]).all()


def test_index_is_read_once_for_many_query_blocks(spark, monkeypatch):
    docs = two_languages(1300, 13)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    passes, searched = [], topk_search._searched
    monkeypatch.setattr(topk_search, "_searched", lambda index, queries, *a: passes.append(len(queries)) or searched(index, queries, *a))
    monkeypatch.setattr(topk_search, "QUERY_BYTES", 10_000)
    got = [tuple(r) for r in search(df, df.where("doc_id % 50 = 0"), k=4).collect()]
    want = brute(docs, [d for d in docs if d[0] % 50 == 0], 4)
    assert sorted((q, r, i) for q, r, i, _ in got) == [(q, r, i) for q, r, i, _ in want]
    assert 1 < max(passes) <= topk_search.PASS and len(passes) == 2
