import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewlake.llm import fingerprints as P

SF = "/root/testdata/sf0.001"


def brute(rows):
    """rows: (doc_id, text). n_chars, sha256 and the fingerprints of each, as one list in the order of the documents."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed_hash(r[1] or "")))
    out = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1] or ""
        t = t or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = (P.fingerprint(x) for x in (t, edited, after))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(P.likeness(a, b), 9), round(P.likeness(a, c), 9)))
    return out


def signed_hash(text):
    return HASHES[text]


HASHES = {}


def compare(spark, rows, **kw):
    df = spark.createDataFrame([(a, b, 1, "x", 2) for a, b in rows], "doc_id long, text string, cell int, tail string, tie int")
    for r in df.selectExpr("coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect():
        HASHES[r.t] = r.h
    got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in P.document_fingerprints(df, **kw).collect()]
    key = lambda r: (r[0] is None, -(r[0] or 0), *map(str, r[1:]))
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


LONG = "".join(chr(97 + i * i % 23) + ("é" if i % 7 == 0 else "") + ("\U0001f600" if i % 1001 == 0 else " ") for i in range(90_000))
CASES = [(9, "one two three four five six seven"), (8, "one two three four five six eight"), (8, "one two three four five six eight"), (8, "a tie"), (5, ""), (4, None), (3, "x"), (2, "ab"), (1, LONG), (-4, LONG[:70_000] + "!" + LONG[70_000:]), (None, "no id"), (None, "no id"), (None, None)]


@pytest.mark.parametrize("cell_rows", [1, 3, 1000])
def test_same_as_brute_force(spark, cell_rows):
    compare(spark, CASES, cell_rows=cell_rows)


def test_few_and_hot_rows(spark):
    compare(spark, [])
    compare(spark, [(7, "only one here, following itself")])
    compare(spark, [(7, "twice")] * 2)
    compare(spark, [(i, f"text number {i} of many {i * i}") for i in range(200)] + [(77, "hot")] * 100 + [(None, "none")] * 100, cell_rows=4)


def test_whole_table(spark):
    from reviewlake.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for r in spark.read.parquet(f"{SF}/documents.parquet").selectExpr("coalesce(text, '') t", "xxhash64(coalesce(text, '')) h").collect():
        HASHES[r.t] = r.h
    got = QUERIES["op11_document_fingerprints"](spark, SF).collect()
    want = {r[0]: r[1:] for r in brute(docs)}
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got} == want
    far = np.array([[r.near_edited, r.near_next] for r in got if r.n_chars >= 100])
    assert far[:, 0].min() > 0.35 and np.quantile(far[:, 1], 0.9) < 0.2


@settings(max_examples=60, deadline=None)
@given(st.text("ab\U0001f600", max_size=60), st.text("ab\U0001f600", max_size=60), st.data())
def test_spans_and_extensions(a, b, data):
    x, y = P.Prefixes(P.points_of(a)), P.Prefixes(P.points_of(b))
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    n = next((k for k in range(min(len(a) - i, len(b) - j)) if a[i + k] != b[j + k]), min(len(a) - i, len(b) - j))
    assert P.common_extension(x, i, y, j) == n
    k, m = data.draw(st.integers(i, len(a))), data.draw(st.integers(j, len(b)))
    assert (x.span(i, k) == y.span(j, m)) == (a[i:k] == b[j:m])
    assert (P.fingerprint(a) == P.fingerprint(b)) == (a == b)
    same = P.likeness(P.fingerprint(a), P.fingerprint(b))
    assert 0 <= same <= 1 and same == P.likeness(P.fingerprint(b), P.fingerprint(a)) and (a != b or same == 1)


def test_stretches_and_sizes(monkeypatch):
    want = P.Prefixes(P.points_of(LONG)).h.copy(), P.Prefixes(P.points_of(LONG)).windows()
    monkeypatch.setattr(P, "STRETCH", 1000)
    assert (P.Prefixes(P.points_of(LONG)).h == want[0]).all() and (P.Prefixes(P.points_of(LONG)).windows() == want[1]).all()
    p, b, h = P.PRIMES[1], P.BASES[1], 0
    for c in P.points_of(LONG[:3000]):
        h = (h * b + int(c) + 1) % p
    assert int(want[0][1, 3000]) == h
    assert all(len(P.fingerprint(LONG[:n])) <= 1 + 8 + 16 + 1 + 8 * (2 * P.GRID + P.SMALLEST) for n in (0, 1, 15, 16, 17, 33, 5000))


def test_likeness_of_copies_with_edits():
    """The estimate is near the true share of windows; a change in one place leaves the prefix and the suffix."""
    draw = np.random.default_rng(3)
    text = "".join(draw.choice(list("abcdefghij klmno"), 6000))
    start = P.fingerprint(text)
    one, many = text[:3000] + "~" + text[3000:], "~" + "".join(c + ("~" if i % 500 == 250 else "") for i, c in enumerate(text))
    assert P.likeness(start, P.fingerprint(one)) > 0.8
    sets = [{t[i : i + P.WINDOW] for i in range(len(t) - P.WINDOW + 1)} for t in (text, many)]
    assert abs(P.likeness(start, P.fingerprint(many)) - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.2
    assert P.likeness(start, P.fingerprint(text[::-1])) < 0.1


def test_extension_of_pairs(spark):
    rows = [("abcdef", 2, "xxcdeq", 2), ("abc", 3, "abc", 0), ("abc", 4, "abc", 0), (None, 0, "a", 0), ("é\U0001f600z", 1, "\U0001f600z!", 0), ("a", None, "a", 0), (LONG, 100, LONG, 100)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, left_text string, left_at long, right_text string, right_at long")
    assert [r.extension for r in P.common_extensions(df).orderBy("k").collect()] == [3, 0, 0, 0, 2, 0, len(LONG) - 100]
