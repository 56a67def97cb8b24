"""Quality classifier: Bradley-Terry pairwise ranking of documents, cut at a quantile of the scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, texts
from .kernels import counts_of, flat, slices, word_bounds, word_hashes

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "bang", "pipe", "non_ascii", "line_rate", "distinct", "repeated_next", "top_word", "distinct_pairs",
    "symbol_words", "upper_words", "empty",
)
_CLASS = np.zeros((256, 7), np.float32)
_CLASS[65:91, 0] = 1
_CLASS[97:123, 1] = 1
_CLASS[48:58, 2] = 1
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,"], 3] = 1
_CLASS[33, 4] = 1
_CLASS[124, 5] = 1
_CLASS[128:, 6] = 1


def features_of(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; all 0 but the last for a text without words."""
    n = len(at) - 1
    size = np.diff(at).astype(float)
    out = np.zeros((n, len(FEATURES)))
    cum = np.zeros((len(data) + 1, 7), np.float32 if len(data) < 1 << 24 else np.float64)
    np.cumsum(_CLASS[data], axis=0, out=cum[1:])
    share = (cum[at[1:]] - cum[at[:-1]]) / np.maximum(size, 1)[:, None]
    lines = np.zeros(len(data) + 1)
    np.cumsum(data == 10, out=lines[1:])
    starts, ends, doc = word_bounds(data, at)
    hashes, _ = word_hashes(data, at)
    per_word = cum[ends] - cum[starts]
    length = (ends - starts).astype(float)
    edge = counts_of(doc, n)
    words = np.diff(edge).astype(float)
    full = np.maximum(words, 1)
    letters = np.maximum(share[:, 0] + share[:, 1] + share[:, 6], 1e-9)

    def mean(x: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0.0], np.cumsum(x)])
        return (c[edge[1:]] - c[edge[:-1]]) / full

    same = np.zeros(len(hashes))
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    distinct, top, pairs = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        w = hashes[edge[i] : edge[i + 1]]
        if len(w):
            _, c = np.unique(w, return_counts=True)
            distinct[i], top[i] = len(c) / len(w), c.max() / len(w)
            pairs[i] = len(np.unique(w[1:] * np.uint64(3) + w[:-1])) / max(1, len(w) - 1)
    out[:, 0], out[:, 1], out[:, 2] = np.log1p(size), np.log1p(words), mean(length)
    out[:, 3] = share[:, 0] / letters
    out[:, 4:9] = share[:, 2:7]
    out[:, 9] = (lines[at[1:]] - lines[at[:-1]]) / full
    out[:, 10], out[:, 11], out[:, 12], out[:, 13] = distinct, mean(same), top, pairs
    out[:, 14] = mean((per_word[:, 3] >= 2).astype(float))
    out[:, 15] = mean((per_word[:, 0] >= np.maximum(1, per_word[:, 1] + 1)).astype(float))
    out[words == 0] = 0
    out[:, 16] = words == 0
    return out


def features(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Returns doc_id and x, the array of FEATURES, a pass over the texts in Arrow batches."""

    def run(batches):
        for part in slices(batches, limit=1 << 19):
            data, at = flat(part.column("text"))
            x = pa.array(list(features_of(data, at)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), x], ["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id long, x array<double>")


class BradleyTerry:
    """score = x . w, learnt from preference pairs: P(a preferred to b) = 1 / (1 + exp(-(score(a) - score(b))))."""

    def __init__(self, l2: float = 1e-3, pairs_per_row: int = 8, max_pairs: int = 200_000, rounds: int = 30, seed: int = 5):
        self.l2, self.per, self.most, self.rounds, self.seed = l2, pairs_per_row, max_pairs, rounds, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> BradleyTerry:
        """Pairs each row with rows of the other label, drawn with a fixed seed. With one label only, all scores are 0."""
        self.mu = x.mean(0) if len(x) else np.zeros(x.shape[1])
        self.sd = np.where(x.std(0) > 1e-9, x.std(0), 1.0) if len(x) else np.ones(x.shape[1])
        self.w, self.cut = np.zeros(x.shape[1]), 0.0
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            return self
        z = np.clip((x - self.mu) / self.sd, -8, 8)
        draw = np.random.default_rng(self.seed)
        n = min(self.most, self.per * len(x))
        a = np.concatenate([np.resize(good, n // 2), draw.choice(good, n - n // 2)])
        b = np.concatenate([draw.choice(bad, n // 2), np.resize(bad, n - n // 2)])
        d = z[a] - z[b]
        for _ in range(self.rounds):  # Newton's method on the logistic loss of the differences
            p = 1 / (1 + np.exp(np.clip(d @ self.w, -30, 30)))
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / n + self.l2 * np.eye(d.shape[1]), d.T @ p / n - self.l2 * self.w)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break
        s = np.sort(z @ self.w)
        k = len(bad)  # the quantile at the share of label 0: midway between the two scores around it
        self.cut = float((s[k - 1] + s[k]) / 2)
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x - self.mu) / self.sd, -8, 8) @ self.w - self.cut
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    The model is learnt from the labelled rows whose crc32 of the id's decimal form is not 1 modulo 3, at most max_rows of
    them, those with the smallest hash of the id; rows with a null label or id are left out, and a document labelled twice
    counts once for each label. Scores are 1 / (1 + exp(cut - x.w)), the cut being the training scores' quantile at the share
    of label 0, so predicted = 1 means above that quantile. Only the text enters a score; null texts count as empty, and
    texts without words all get one score. Without two labels to learn from, every score is 0.5.
    """
    x = save(features(texts(docs, id_col, text_col)), "features")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null").distinct()
    sample = x.where(remainder != 1).join(wanted, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows).toPandas()
    xs = np.array(sample["x"].tolist(), float).reshape(len(sample), len(FEATURES))
    model = BradleyTerry().fit(xs, sample["quality"].to_numpy())

    def run(batches):
        for b in batches:
            if b.num_rows:
                v = np.asarray(b.column("x").flatten()).reshape(b.num_rows, len(FEATURES))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(v))], ["doc_id", "score"])

    scored = x.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (remainder == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
