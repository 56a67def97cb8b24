"""The operators' queries over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import exact_dedup
from .fingerprints import document_fingerprints
from .importance import resample
from .line_dedup import WHOLE, line_dedup
from .mixing import mix_sources
from .ngram_join import ngram_jaccard
from .piece_nbest import decoded, encode_nbest
from .quality import score_quality
from .repeated_spans import remove_repeats
from .secret_scan import scan_secrets
from .token_store import write_and_digest
from .topk_search import search
from .whitening import whiten

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_bm25_search(spark, sf_dir):
    """The ten best documents for every document whose id is divisible by 50, its whole text as the query."""
    docs = table(spark, sf_dir, "documents")
    found = search(docs, docs.where("doc_id % 50 = 0"), k=10)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


def op2_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents"), **WHOLE)


def op3_token_store(spark, sf_dir):
    return write_and_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op4_piece_nbest(spark, sf_dir):
    """The four best segmentations of every text: their scores, pieces and the text that they decode to."""
    model = public_tokenizers.path(PIECE_BPE)
    rows = decoded(encode_nbest(table(spark, sf_dir, "documents"), model, 4), model)
    return rows.select("doc_id", "rank", "score", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_document_fingerprints(spark, sf_dir):
    return document_fingerprints(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark, sf_dir):
    """A tenth of the documents of 20 words or more, drawn by how much their words are like those of benchmark."""
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, least_words=20, percent=10, seed=2024)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_embedding_whitening(spark, sf_dir):
    """The eight first whitened components of every usable vector; a deviation that is no 64-bit integer any more is null."""
    found = whiten(table(spark, sf_dir, "embeddings"), components=8, scale=1024.0, offset=100_000)
    return found.withColumn("deviation", F.expr("try_cast(deviation as long)"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bm25_search, op2_line_dedup, op3_token_store, op4_piece_nbest, op5_exact_dedup, op6_quality, op7_ngram_jaccard, op8_secret_scan, op9_mixing, op10_suffix_dedup,
        op11_document_fingerprints, op12_importance_resampling, op13_embedding_whitening,
    )
}

ORACLE_SQL = {
    "op1_bm25_search": r"""
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE doc_id IS NOT NULL),
             w AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS term FROM d),
             f AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2), l AS (SELECT doc_id, count(*) AS len FROM w GROUP BY 1), df AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
             st AS (SELECT (SELECT count(*) FROM d)::DOUBLE AS n, (SELECT count(*) FROM w)::DOUBLE / (SELECT count(*) FROM d) AS mean),
             s AS (SELECT q.doc_id AS query_id, f.doc_id, sum(q.tf * ln(1 + (n - df + 0.5) / (df + 0.5)) * f.tf * 2.2::DOUBLE / (f.tf + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * len / mean))) AS score
                   FROM f q JOIN df ON df.term = q.term JOIN f ON f.term = q.term JOIN l ON l.doc_id = f.doc_id, st WHERE q.doc_id % 50 = 0 GROUP BY 1, 2)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) <= 10""",
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
             w AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256 FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w""",
    "op7_ngram_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             sh AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
             n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
             b AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
             l AS MATERIALIZED (SELECT a, b FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
             r(node, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.node WHERE r.c < l.b)
        SELECT r.node AS doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY 1""",
    # crc32 by its table of the polynomial 0xEDB88320, a byte at a time; only distinct words are hashed.
    "op12_importance_resampling": r"""
        WITH RECURSIVE bits(b, step, v) AS (SELECT range, 0, range::BIGINT FROM range(256) UNION ALL SELECT b, step + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE step < 8),
             tab AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE step = 8),
             w AS MATERIALIZED (SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
                   UNION ALL SELECT 'b', item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
             u AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM w)),
             k AS MATERIALIZED (SELECT word, xor(list_reduce([4294967295::BIGINT] || list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)])), 4294967295) % 10000 AS bucket FROM u, tab),
             c AS (SELECT bucket, count(*) FILTER (side = 'd')::DOUBLE AS s, count(*) FILTER (side = 'b')::DOUBLE AS t FROM w JOIN k USING (word) GROUP BY 1),
             g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM c) + 10000) / ((s + 1) * ((SELECT sum(t) FROM c) + 10000))))::BIGINT AS gain FROM c),
             f AS (SELECT id, count(*) AS n, sum(gain) AS weight FROM w JOIN k USING (word) JOIN g USING (bucket) WHERE side = 'd' GROUP BY 1),
             r AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN f ON id = doc_id),
             e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM r),
             p AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS many FROM e)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= many * 10 // 100 THEN place END AS rank FROM p""",
}
