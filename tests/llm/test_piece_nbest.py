import os
import random
import subprocess
import sys

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from reviewlake.llm import queries as Q
from reviewlake.llm.piece_nbest import PieceModel, best_sums, decoded, encode_nbest

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
PIECES = {sp.id_to_piece(i).replace("▁", " "): (i, round(sp.get_score(i))) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
LEAST = min(s for _, s in PIECES.values()) - 10


def brute(text):
    """All segmentations: (-score, ids)."""
    if not text:
        return [(0, ())]
    out = []
    for w in range(1, min(16, len(text)) + 1):
        piece = text[:w]
        if piece in PIECES:
            first = [((PIECES[piece][0],), PIECES[piece][1])]
        elif w == 1:
            first = [(tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in piece.encode()), LEAST)]
        else:
            continue
        out += [(c - s, ids + rest) for ids, s in first for c, rest in brute(text[w:])]
    return out


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_against_all_segmentations(n):
    rng = random.Random(n)
    made = ["".join(rng.choice("thenrsaé 日\n͸") for _ in range(rng.randint(0, 9))) for _ in range(120)] + ["the the the", "aaaa aaaa", "▁a", "  ", "\U0001f600x"]
    model = PieceModel(PATH)
    for text, found in zip(made, model.encode(made, n)):
        plain = (" " + text.replace("▁", " ")) if text else ""
        want = sorted(brute(plain))
        assert len(found) == min(n, len(want))
        assert [-s for s, _ in found] == [c for c, _ in want[: len(found)]]
        assert len({tuple(x) for _, x in found}) == len(found)
        for s, ids in found:
            assert (-s, tuple(int(x) for x in ids)) in want
            assert model.decode(ids.astype(np.int64)) == text.replace("▁", " ") == sp.decode([int(x) for x in ids])


def test_best_sums():
    rng = random.Random(1)
    for _ in range(200):
        items = sorted((rng.randint(0, 5), rng.randint(0, 4)) for _ in range(rng.randint(0, 7)))
        every = [()]
        for i in range(len(items)):
            every += [(i, *x) for x in every]
        want = sorted((sum(items[i][0] for i in x), x) for x in every if len({items[i][1] for i in x}) == len(x))
        assert best_sums(items, 6) == want[:6]


LONG = """
import random, resource, sys
import numpy as np
from reviewlake.llm.piece_nbest import PieceModel
model = PieceModel(sys.argv[1])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rng = random.Random(5)
for text in ("".join(rng.choice("thenrsaé日") for _ in range(200_000)), "x" * 200_000):
    found = model.encode([text], 4)[0]
    assert len(found) == 4 and found == sorted(found, key=lambda f: -f[0]) and len({ids.tobytes() for _, ids in found}) == 4
    assert all(model.decode(ids.astype(np.int64)) == text for _, ids in found)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_long_texts_without_a_space():
    out = subprocess.run([sys.executable, "-c", LONG, PATH], capture_output=True, text=True, cwd=os.path.dirname(corpus_pipeline.__file__))
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 500


def test_round_trip(spark):
    rows = [(1, "Hello  world\n\tagain "), (2, None), (3, ""), (4, "x" * 3000 + " y"), (5, "a b " * 9000), (None, "é͸"), (1, "again"), (1, "again")]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, rank int, ids string")
    got = decoded(encode_nbest(df, PATH, 3), PATH).collect()
    assert sorted((str(r.doc_id), r.text) for r in got if r["rank"] == 1) == sorted((str(i), t or "") for i, t in rows)
    assert {r.text for r in got} == {t or "" for _, t in rows}
    assert encode_nbest(df.limit(0), PATH).count() == 0


def test_query(spark):
    got = Q.op4_piece_nbest(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.where("rank = 1").join(docs, "doc_id").where("text_crc32 = crc32(cast(text as binary))").count() == docs.count()
    assert got.groupBy("doc_id").agg({"text_crc32": "max", "rank": "max"}).where("`max(rank)` = 4").count() == docs.count()
