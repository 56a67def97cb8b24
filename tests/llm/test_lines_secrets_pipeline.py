import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reviewlake.llm import queries as Q
from reviewlake.llm.line_dedup import WHOLE, line_dedup
from reviewlake.llm.mixing import mix_sources
from reviewlake.llm.quality import score_quality
from reviewlake.llm.secret_scan import KINDS, candidates, dictionary, labelled_findings, scan_secrets

SF = "/root/testdata/sf0.001"
GAP = re.compile("[\x20\x09-\x0d]+")
FIELD = "<*>"


def masked(tokens):
    return [FIELD if re.search("[0-9]", t) else t for t in tokens]


def brute_lines(texts, min_docs, depth=3, min_tokens=3, fixed_share=0.8):
    """By distinct documents; parses as line_dedup says."""
    holders = defaultdict(set)
    for d, text in enumerate(sorted(set(texts))):
        for line in text.split("\n"):
            tokens = tuple(GAP.split(line.strip("\x20\t\n\x0b\x0c\r")))
            if len(tokens) >= min_tokens and tokens != ("",):
                holders[(len(tokens), *masked(tokens[:depth])), tokens].add(d)
    support = Counter()
    for (leaf, tokens), d in holders.items():
        for at, t in enumerate(masked(tokens)):
            support[leaf, at, t] += len(d)
    met, template = defaultdict(set), {}
    for (leaf, tokens), d in holders.items():
        m = masked(tokens)
        fixed = [t != FIELD and support[leaf, at, t] >= min_docs for at, t in enumerate(m)]
        share = sum(f or t == FIELD for f, t in zip(fixed, m)) / len(m)
        if len(m) < 3 and not any(fixed):
            own = tokens
        else:
            own = [t if f else FIELD for f, t in zip(fixed, m)] if share >= fixed_share and (any(fixed) or share >= 0.8) else m
        template[leaf, tokens] = (leaf, *own)
        met[template[leaf, tokens]] |= d
    gone = {tokens for (leaf, tokens), t in template.items() if len(met[t]) >= min_docs}
    return ["\n".join(x for x in text.split("\n") if tuple(GAP.split(x.strip("\x20\t\n\x0b\x0c\r"))) not in gone) for text in texts]


def test_line_dedup(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("the of and server node error ready user log in at".split()) + rng.choice("abcdefgh")
    texts = []
    for i in range(120):
        lines = [" ".join(word() for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 4))]
        lines.insert(rng.randint(0, len(lines)), rng.choice([f"user {i} logged in at 10:{i % 60}", "Subscribe to our news now", f"error {word()} on server number {i}", " two tokens ", ""]))
        texts.append("\n".join(lines))
    texts += [texts[0]] * 30 + ["", "one line only\n" * 80]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, None, 1, "x"), (3, texts[3], 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, content int, leaf string")
    got = line_dedup(df, min_docs=8, carry=("leaf",)).collect()
    want = brute_lines(texts, 8)
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([*((str(i), t) for i, t in enumerate(want)), ("None", ""), ("3", want[3])])
    assert want[:120] != texts[:120] and {r.leaf for r in got} == {"x"}
    assert line_dedup(df.limit(0)).count() == 0


def test_line_dedup_counts_documents(spark):
    footer = ["All rights reserved by us", "Terms of use apply here", "Contact the editors by mail"]
    apart = ["Menu of this fine site", "", "Archive of the older posts", "", "Imprint and other legal notes"]
    texts = ["\n".join([f"{chr(97 + i)} text of its own", *apart, *footer]) for i in range(12)]
    texts += ["\n".join(x for k in range(40) for x in ("this line comes again", f"{chr(97 + k % 26)}{k // 26} is between"))]
    texts += ["only in copies of one"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup(df, min_docs=10).collect()}
    assert all(got[i].text == f"{chr(97 + i)} text of its own\n\n" and got[i].n_dropped == 6 for i in range(12))
    assert all(got[i].text == t and got[i].n_dropped == 0 for i, t in enumerate(texts) if i >= 12)


def test_lines_of_every_length_and_words_that_vary(spark, tmp_path):
    w = [chr(97 + i % 26) + chr(97 + i // 26) for i in range(40)]
    own = [f"{w[i]} is only here\n{i}7\n{i} {i} {i} {w[i]}b {w[i]}c {w[i]}d" for i in range(32)]
    texts = [f"{own[i]}\nRead more\nLogin\nThe file was {w[i]} by {w[i + 1]}\nPage {i}" for i in range(32)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for cut in (corpus_pipeline.lines(spark, docs, str(tmp_path)), Q.op2_line_dedup(spark, str(tmp_path))):
        assert {r.doc_id: r.text for r in cut.collect()} == dict(enumerate(own))


def test_secret_scan(spark):
    held = labelled_findings(spark, 6000).where("doc_id >= 4000")
    found = scan_secrets(held.drop("label"))
    right = found.join(held, "doc_id").agg(F.avg((F.col("is_secret") == (F.col("label") == 1)).cast("double"))).first()[0]
    assert right > 0.97
    rows = [(1, "key ghp_" + "Ab1" * 12 + " and again ghp_" + "Ab1" * 12), (2, None), (3, ""), (None, "token=\"x9Kq2mB7vRt4\""), (4, "plain text. " * 9000), (1, "AKIA" + "Q7" * 8)]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, kind string, start int")
    got = sorted((str(r.doc_id), r.kind, r.start) for r in scan_secrets(df).collect())
    assert got == [("1", "cloud_key", 0), ("1", "forge_token", 4), ("None", "assigned", 7)]
    assert scan_secrets(df.limit(0)).count() == 0
    assert Q.op8_secret_scan(spark, SF).columns[:3] == ["doc_id", "kind", "start"]


def brute_candidates(text):
    pattern = re.compile("|".join(f"(?:{p})" for p in KINDS.values()))
    out = {}
    for m in pattern.finditer(text):
        kind = next(k for k, p in KINDS.items() if k == "long_run" or re.match(p, m[0]))
        value = re.search(r"[:=]\x20{0,4}[\x22']?(.*)$", m[0])[1] if kind == "assigned" else m[0]
        out.setdefault((m[0], kind, value), []).append(m.end() - len(value))
    return sorted((kind, value, starts) for (_, kind, value), starts in out.items())


def test_candidates_against_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    extra = spark.createDataFrame([(-1, "a" * 30 + " pwd='" + "Zz9" * 4 + "' x" + "b" * 30 + " " + "a" * 30), (-2, "api_key=" + "q" * 100_000 + " token: " + "é" * 9)], "doc_id long, text string")
    rows = docs.union(extra)
    got = {}
    for r in candidates(rows).collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.value, list(r.starts)))
    assert {i: sorted(x) for i, x in got.items()} == {r.doc_id: brute_candidates(r.text) for r in rows.collect() if brute_candidates(r.text)}


def test_words_of_the_corpus_are_no_secrets(spark):
    word = "handelsregisterauszugsverwaltungsbeamter"
    texts = [f"text {i} of the {word} und so weiter" for i in range(25)] + [f"der {word[:20]}{word[20:]} kam", "Bearer wJb7rXUt3FEM1K8MDENGbPxRfiCYq2zKLmN0pQsT"] + ["copy qzvkwjxhqzvkwjxhqzvkwjxhqz here"] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = candidates(df)
    assert {r.word for r in dictionary(df, found).collect()} == {word}  # exact copies are one text
    got = {r.doc_id: r.is_secret for r in scan_secrets(df).collect()}
    assert got[26] and not got[25] and not any(got[i] for i in range(25))


def test_bare_secrets_and_longer_names(spark):
    bare = "wJb7rXUt3FEM1K8MDENGbPxRfiCYq2zKLmN0pQsT"
    true = ["Authorization: Bearer " + bare, f"aws_secret_access_key = {bare}", f'client_secret_key: "{bare[:30]}"', "pwd=x9Kq2mB7vRt4", "DB_PASS=x9Kq2mB7vRt4", "my_DB_PASSWORD=x9Kq2mB7vRt4Lw8Z", "Bearer " + "qWjKvZxGfBtRmPLsDhYcNaUe" * 2]
    false = ["commit 3f786850e387550fdab836ed7e6dc881de23001b", "-" * 60, "the internationalizationhandwerkskammer of"]
    df = spark.createDataFrame(list(enumerate([*true, *false, f"é Bearer {bare} or Bearer {bare}"])), "doc_id long, text string")
    got = {r.doc_id: r for r in scan_secrets(df).collect()}
    n = len(true)
    assert [got[i].is_secret for i in range(n + len(false))] == [True] * n + [False] * len(false)
    assert [got[i].start for i in range(n)] == [22, 24, 20, 4, 8, 15, 7] and {got[i].kind for i in range(1, 6)} == {"assigned"}
    assert got[n + 3].starts == [9, 9 + 40 + 11] and got[n + 3].start == 9


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.save(stage(spark, out[-1], SF), "t"))
    return out


def test_pipeline(spark, stages):
    docs, good, cut, alone, mixed, encoded = stages
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_duplicates", "mixing", "pieces"] and all(s.columns == docs.columns for s in stages[:5])
    rows = [{r.doc_id: r for r in s.collect()} for s in stages[:4]]
    kept = {r.doc_id for r in score_quality(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert set(rows[1]) == kept and all(rows[1][i] == rows[0][i] for i in kept)
    ids = sorted(kept)
    assert [rows[2][i].text for i in ids] == brute_lines([rows[1][i].text for i in ids], 30, min_tokens=1, fixed_share=0.5)
    assert all(r.n_chars == len(r.text) for r in rows[2].values())
    from tests.llm.test_ngram_join import brute

    assert set(rows[3]) == {i for i, _, c in brute([(i, rows[2][i].text) for i in ids]) if c == i}
    times = Counter(r.doc_id for r in mixed.collect())
    assert times == Counter({r.doc_id: r.copies for r in mix_sources(alone).collect() if r.copies})
    first = encoded.where("rank = 1")
    assert Counter(r.doc_id for r in first.collect()) == times
    from reviewlake.llm.piece_nbest import decoded

    text = {r.doc_id: r.text for r in decoded(first, corpus_pipeline.public_tokenizers.path(corpus_pipeline.PIECES)).collect()}
    assert text == {i: rows[3][i].text for i in text}
    assert corpus_pipeline.run(spark, SF).count() == encoded.count()


def test_stages_take_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(0).union(spark.createDataFrame([(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", "s", 0), (2, "x", "en", None, 1)], docs.schema))
    for rows in (docs.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, rows, SF).collect()


def test_stages_carry_further_columns(spark):
    """Columns named as those that stages and operators use inside come along unchanged, also beside a very long text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    long_text = " ".join(f"word{i % 5003} and{i}" for i in range(60_000))
    docs = docs.union(spark.createDataFrame([(10_000, long_text, "en", "s", len(long_text)), (10_000, long_text, "en", "s", len(long_text))], docs.schema))
    names = ("copies", "_nth", "n_lines", "n_dropped", "content", "component_id", "score", "label", "_row")
    rows = docs.withColumns({c: F.concat(F.lit(f"{c} "), "doc_id") for c in names})
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        rows = corpus_pipeline.save(stage(spark, rows, SF), "t")
        assert rows.columns == [*docs.columns, *names]
    # Not all of the rows are taken by the mix; those that are have what they came with.
    got = rows.collect()
    assert got and all(r[c] == f"{c} {r.doc_id}" for r in got for c in names)
    scored = corpus_pipeline.quality(spark, docs.withColumns({c: F.lit(c) for c in names}), SF)
    assert scored.columns == [*docs.columns, *names] and scored.count() > 0


def test_candidates_of_texts_with_many_of_them(spark):
    """50,000 digests in one text, a third of them repeated, and rows with equal id and text."""
    import hashlib
    import time

    many = "\n".join(f"{'é' * (n % 3)} {hashlib.sha1(str(n % 33_000).encode()).hexdigest()}  file{n}.txt" for n in range(50_000))
    few = "\U0001f600 password=abcdefgh1 x " * 3 + "token: abcdefgh1"
    df = spark.createDataFrame([(1, many), (2, few), (3, few), (3, few)], "doc_id long, text string")
    start = time.time()
    rows = candidates(df).collect()
    assert time.time() - start < 60
    big = [r for r in rows if r.doc_id == 1]
    assert len(big) == 33_000 and sum(len(r.starts) for r in big) == 50_000
    for r in big[:: 97]:
        assert all(many[p : p + 40] == r.value for p in r.starts) and r.start == r.starts[0] == min(r.starts)
        assert r.left == many[max(0, r.start - 48) : r.start] and r.right == many[r.start + 40 : r.start + 88]
    small = [(r.doc_id, r.kind, r.value, tuple(r.starts), r.left, r.right) for r in rows if r.doc_id != 1]
    want = [("assigned", "abcdefgh1", tuple(11 + 23 * n for n in range(3)), few[:11], few[20:68]), ("assigned", "abcdefgh1", (few.rindex("abc"),), few[: few.rindex("abc")][-48:], "")]
    assert sorted(small) == sorted((i, *w) for i in (2, 3, 3) for w in want)


def test_documents_of_very_many_lines(spark):
    """100,000 lines, half of which go, in one document."""
    shared = [f"shared line number {'abcdefghij'[n % 10]} of all" for n in range(10)]
    long = "\n".join(shared[n // 2 % 10] if n % 2 else f"own {n} w{n * 7919}x q{n}" for n in range(100_000))
    rows = [(1, long)] + [(10 + i, f"first {i} of u{i * 31}v\n" + "\n".join(shared)) for i in range(40)]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), **WHOLE).collect()}
    assert got[1].n_lines == 100_000 and got[1].text == "\n".join(x for x in long.split("\n") if x not in shared) and got[1].n_dropped == 50_000
    # The first lines have a template in common, too.
    assert got[10].n_dropped == 11 and got[10].text == ""
