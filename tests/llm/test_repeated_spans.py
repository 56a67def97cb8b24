import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from reviewlake.llm import repeated_spans
from reviewlake.llm.kernels import flat
from reviewlake.llm.repeated_spans import remove_repeats


def brute(rows, length):
    seen = Counter()
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, r in raws:
        seen.update(r[k : k + length] for k in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(length // 3) for _ in range(4)]
    rows = []
    for i in range(n):
        t = text(rng.randint(0, length))
        if rng.random() < 0.5:
            t += rng.choice(passages) + text(rng.randint(0, 40))
        if rng.random() < 0.3 and rows:
            base = list(rng.choice(rows)[1] or "")
            for _ in range(rng.randint(0, 3)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice("xyz")
            t = "".join(base)
        rows.append((i, t))
    return rows + [(None, None), (n, ""), (n + 1, "ab " * 200), (n + 2, "ab " * 30), (n + 3, "q" * length), (n + 4, "q" * (length - 1)), (3, rows[3][1])]


@pytest.mark.parametrize(("seed", "length", "share"), [(1, 40, None), (2, 40, 9), (3, 200, None)])
def test_against_brute_force(spark, seed, length, share):
    rows = corpus(seed, 60, length)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, cid int, kept string")
    got = sorted((tuple(r) for r in remove_repeats(df, length=length, share=share).drop("kept").collect()), key=str)
    assert got == brute(rows, length)


def test_long_texts_in_stretches(spark, monkeypatch):
    # A stretch cuts runs and passages; nothing depends on where. Executors in this test's process read the module's value.
    long = " ".join(f"w{i * i % 977}x{i}" for i in range(2500))
    rows = [(1, long), (2, "head " + long[5000:9000] + " tail"), (3, "x" * 700), (4, long[:300][::-1])]
    monkeypatch.setattr(repeated_spans, "STRETCH", 1000)
    data, at = flat(pa.array([t for _, t in rows]))
    got = []
    for begin in range(0, len(data), 1000):
        end = min(len(data), begin + 1000 + 39)
        doc, first, last, anchor, _ = repeated_spans.minimizer_runs(data[begin:end], np.clip(at, begin, end) - begin, 40, 13)
        got += [(d, w + begin, a + begin) for d, f, x, a in zip(doc, first, last, anchor) for w in range(f, x + 1)]
    doc, first, last, anchor, _ = repeated_spans.minimizer_runs(data, at, 40, 13)
    assert got == [(d, w, a) for d, f, x, a in zip(doc, first, last, anchor) for w in range(f, x + 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in remove_repeats(df).drop("kept").collect()), key=str) == brute(rows, 200)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
