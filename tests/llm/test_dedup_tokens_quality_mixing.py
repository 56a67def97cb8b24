import hashlib
import re
import struct
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import queries as Q
from reviewlake.llm import exact_dedup as exact
from reviewlake.llm.common import components, save, scratch
from reviewlake.llm.exact_dedup import exact_dedup
from reviewlake.llm.mixing import MAX_REPEATS, mix_sources
from reviewlake.llm.quality import BradleyTerry, features_of, score_quality
from reviewlake.llm.kernels import flat
from reviewlake.llm.token_store import WordCoder, read_tokens, token_digests, write_tokens

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, source string, n_chars long, digest string, kept string"
LONG = " ".join(f"w{i % 97}x{i}" for i in range(30_000))


def docs(spark, rows):
    """rows: (doc_id, text, source); further columns have names that operators use inside."""
    return spark.createDataFrame([(a, b, c, 1, "x", "y") for a, b, c in rows], DOC)


CASES = [(1, "a b\tc", "s1"), (2, "abc", "s1"), (3, "a  b c", None), (4, None, "s2"), (5, "", "s2"), (6, " \n", None), (7, LONG, "s0"), (8, "É x", "s0"), (8, "É x", "s0"), (None, "abc", "s3"), (10, "Hello WORLD, it's 42!", "é")]


def brute_keep(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is not None, i or 0))
    return {k: (min(v)[2] if min(v)[1] else None, len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("digest", [None, lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)])
def test_exact_dedup(spark, digest):
    want = brute_keep(CASES)
    got = exact_dedup(docs(spark, CASES), digest=digest).collect()
    assert len(got) == len(CASES)
    by_id = {(i, hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", t or "").encode()).hexdigest()): want[re.sub("[\x20\x09-\x0d]", "", t or "")] for i, t, _ in CASES}
    for r in got:
        assert (r.keep_id, r.group_size) == by_id[r.doc_id, r.text_sha256]
        assert r.kept == (r.doc_id == r.keep_id)
    assert exact_dedup(docs(spark, [])).count() == 0


def test_hot_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(exact, "PART", 3)
    rows = [(i, " " * (i % 4) + "hot text", None) for i in range(50)] + [(100 + i, f"text {i % 7}", None) for i in range(20)] + [(200, "alone", None), (None, "hot text", None)]
    for digest in (None, lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs(spark, rows), digest=digest).collect()}
        want = brute_keep(rows)
        assert got == {i: (*want[re.sub(" ", "", t)], i == want[re.sub(" ", "", t)][0]) for i, t, _ in rows}


def test_index_of_several_batches(spark):
    rows = lambda *batch: scratch_table(spark, [(d, i, n) for d, i, n in batch], "digest string, doc_id long, n_chars long")
    index = exact.DigestIndex(fanout=2).flush(rows(("a", 5, 3), ("a", 2, 3), ("b", 1, 9))).flush(rows(("b", 7, 10), ("c", 8, 1))).flush(rows(("a", 1, 3), ("d", 3, 1)))
    assert [len(level) for level in index.levels] == [1, 1] and all(r.filter for r in index.runs())
    new = rows(("a", 0, 3), ("d", 9, 1), ("e", 9, 1))
    got = {r.digest: (r.best.doc_id, r.n) for r in index.lookup(new).collect()}
    assert got == {"a": (1, 3), "d": (3, 1)}
    assert {r.digest: (r.best.doc_id, r.n) for r in index.repeated().collect()} == {"a": (1, 3), "b": (7, 2)}
    # The filter of a run holds back digests that it does not have.
    asked = scratch_table(spark, [(f"x{i}",) for i in range(1000)], "digest string")
    assert exact.probed(asked, index.runs()[0].filter, "digest")[0].count() < 10


def test_query_asks_the_filters(spark, monkeypatch):
    """The operator's own index: one compacted run, whose entries the newest batch's filter mostly holds back, and that batch."""
    made = []
    repeated = exact.DigestIndex.repeated
    monkeypatch.setattr(exact.DigestIndex, "repeated", lambda self: made.append(self) or repeated(self))
    rows = [(i, f"text {i}", None) for i in range(2000)] + [(5000 + i, f"text  {i}", None) for i in range(100)]
    got = {r.doc_id: r.keep_id for r in exact_dedup(docs(spark, rows)).collect()}
    assert got == {**{i: i for i in range(100, 2000)}, **{i: 5000 + i for i in range(100)}, **{5000 + i: 5000 + i for i in range(100)}}
    (index,) = made
    assert [len(level) for level in index.levels] == [1, 1]
    new, old = index.runs()
    assert old.merged and not new.merged and new.entries.count() + old.entries.agg(F.sum("n")).first()[0] == 2100
    asked = exact.probed(old.entries, new.filter, "digest")
    both = old.entries.join(new.entries.select("digest").distinct(), "digest", "left_semi").count()
    assert both <= asked[0].count() < both + 20 and asked[0].count() + asked[1].count() == old.entries.count()


def scratch_table(spark, rows, schema):
    return save(spark.createDataFrame(rows, schema), "t")


def test_exact_dedup_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(Q.ORACLE_SQL["op5_exact_dedup"]).fetchall()
    assert sorted(want) == sorted(map(tuple, Q.op5_exact_dedup(spark, SF).collect()))


def test_token_store(spark):
    from tokenizers import Tokenizer

    model = public_tokenizers.path(Q.WORD_BPE)
    coder = Tokenizer.from_file(model)
    df = docs(spark, CASES).union(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 100", "text", "source", "n_chars", "'a'", "'b'"))
    path = scratch(spark, "t")
    write_tokens(df, path, model, block_bytes=20_000)
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    start, want = 0, []
    for i, t in rows:
        ids = coder.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = [tuple(r) for r in token_digests(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    some = {r.doc_id: r.ids for r in read_tokens(spark, path, doc_ids=[10, 150]).collect()}
    assert set(some) == {10, 150} and some[10] == coder.encode(CASES[-1][1], add_special_tokens=False).ids + [2]
    assert Q.op3_token_store(spark, SF).count() == 200
    empty = scratch(spark, "e")
    write_tokens(docs(spark, []), empty, model)
    assert token_digests(spark, empty).count() == 0


ADDED = ["<|startoftext|> <|STARTOFTEXT|>", "<|STARTOFTEXT|> <|startoftext|>", "a<|EndOfText|>b <|endoftext|>c", "H\u0331 h\u0331", "plain Words WORDS words", "x" * 40_000, "tail <|endof", "text|> head"]


@pytest.mark.parametrize("order", [1, -1])
def test_word_coder_is_the_library(order):
    from tokenizers import Tokenizer

    model = public_tokenizers.path(Q.WORD_BPE)
    coder, own = Tokenizer.from_file(model), WordCoder(model, most=300)
    for batch in ([ADDED[:4][::order], ADDED[4:][::order], ADDED[::order]], [[t] for t in ADDED[::order]], [[" ".join(f"w{i}" for i in range(k, k + 250))] for k in range(0, 1000, 125)]):
        for texts in batch:
            got = own.encode_each(*flat(pa.array(texts)))
            assert [x.tolist() for x in got] == [coder.encode(t, add_special_tokens=False).ids for t in texts]


def test_quality(spark):
    q = score_quality(docs(spark, CASES), spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int"))
    rows = q.collect()
    assert len(rows) == len(CASES) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert {r.doc_id: r.held_out for r in rows if r.doc_id} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in CASES if i}
    none = score_quality(docs(spark, CASES), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in none.collect()} == {0.5}
    got = Q.op6_quality(spark, "/root/testdata/sf0.01")
    right = got.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right >= 0.95


def test_bradley_terry():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x @ [2.0, -1.0, 0.0] > 0.5).astype(int)
    s = BradleyTerry().fit(x, y).scores(x)
    assert ((s >= 0.5) == y).mean() > 0.97
    assert features_of(np.zeros(0, np.uint8), np.zeros(3, np.int64)).shape[0] == 2


def brute_targets(sizes):
    key = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(key)}
    left, free, out = sum(sizes.values()), list(key), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > MAX_REPEATS * sizes[s]]
        for s in over or free:
            out[s] = MAX_REPEATS * sizes[s] if over else level * weight[s]
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in over] if over else []
    return out


def test_mixing(spark):
    rows = CASES + [(100 + i, "w " * (i % 50 + 1), "big" if i % 3 else f"s{i % 5}") for i in range(600)]
    got = mix_sources(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= MAX_REPEATS * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.05 * want[s], 3 * max(1, sizes[s] // 256)), s
    again = mix_sources(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mix_sources(docs(spark, [])).count() == 0
    assert [r.taken for r in mix_sources(docs(spark, [(1, None, None)])).collect()] == [0]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 70), (70, 100), (200, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 50, 50: 50, 70: 50, 200: 200, 300: 200}
