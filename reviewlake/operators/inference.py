"""Models from outside: extraction of triples and reranking, in Arrow batches on the executors, with deterministic defaults.

A model is a function of a batch. Batches are bounded, work that is already cached is left out by an anti join, and each row
carries an error column, so one bad answer never fails a job.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Extractor = Callable[[list[str]], list[list[dict]]]
TRIPLES = "array<struct<aspect:string,opinion:string,sentiment:string,confidence:double>>"
# Fixed values of the default extractor: words that carry a sentiment.
POSITIVE = "good great love excellent nice soft perfect best fresh happy".split()
NEGATIVE = "bad poor hate terrible broken worst harsh weak cheap sad".split()


def lexicon_extractor(texts: list[str]) -> list[list[dict]]:
    """A word of sentiment and the word after it; no model needed."""
    out = []
    for text in texts:
        words = re.findall("[a-z]+", text.lower())
        found = [(a, w, "positive" if w in POSITIVE else "negative") for w, a in zip(words, words[1:]) if w in POSITIVE or w in NEGATIVE]
        out.append([{"aspect": a, "opinion": w, "sentiment": s, "confidence": 0.8} for a, w, s in dict.fromkeys(found)])
    return out


def extract_triples(reviews: DataFrame, extractor: Extractor = lexicon_extractor, cached: DataFrame | None = None, batch: int = 64) -> DataFrame:
    """reviews: review_id, text. review_id, triples, error, for reviews that are not cached (review_id) yet.

    A failing batch is tried again row by row, so that only the rows at fault end with an error.
    """
    todo = reviews.select("review_id", "text").where("trim(coalesce(text, '')) <> ''")
    if cached is not None:
        todo = todo.join(cached.select("review_id"), "review_id", "left_anti")

    def one(texts: list[str]) -> tuple[list, list]:
        try:
            return extractor(texts), [None] * len(texts)
        except Exception as e:  # noqa: BLE001 a model may fail in any way; the row says how
            if len(texts) == 1:
                return [[]], [f"{type(e).__name__}: {e}"]
            parts = [one([t]) for t in texts]
            return [p[0][0] for p in parts], [p[1][0] for p in parts]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                triples, errors = one(part["text"].tolist())
                yield pd.DataFrame({"review_id": part["review_id"].to_numpy(), "triples": triples, "error": errors})

    kind = dict(reviews.dtypes)["review_id"]
    return todo.mapInPandas(run, f"review_id {kind}, triples {TRIPLES}, error string")


def validated(triples: DataFrame, keep: float = 0.5, fast: float = 0.85) -> DataFrame:
    """triples: review_id, triples. Adds fast (all are confident, no second opinion needed) and drops the unsure ones."""
    sure = F.forall("triples", lambda t: t["confidence"] >= fast)
    return triples.withColumn("fast", sure).withColumn("triples", F.filter("triples", lambda t: t["confidence"] >= keep))


def rerank(pool: DataFrame, ranker: Callable[[str, list[str]], list[str]] | None = None) -> DataFrame:
    """pool: user_id, item, rank, query (text). The user's items as the ranker orders them, its omissions after them in order;
    without a ranker, or where it fails, the pool as it is. A pool is a short list by construction."""
    if ranker is None:
        return pool.select("user_id", "item", "rank")

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        items = pdf["item"].tolist()
        known = set(items)
        try:
            said = [i for i in dict.fromkeys(ranker(pdf["query"].iloc[0], items)) if i in known]
        except Exception:  # noqa: BLE001 closed by design: any failure keeps the numeric order
            said = []
        named = set(said)
        said += [i for i in items if i not in named]
        return pd.DataFrame({"user_id": pdf["user_id"].iloc[0], "item": said, "rank": range(1, len(said) + 1)})

    return pool.select("user_id", "item", "rank", "query").groupBy("user_id").applyInPandas(order, "user_id string, item string, rank int")


def form_batches(jobs: DataFrame, size: int, budget: int, lanes: int = 1024) -> DataFrame:
    """jobs: user_id, ts, cost. Adds batch: at most `size` jobs that, unless a single job is dearer, cost at most `budget`.

    Jobs of one user and time stay together unless they are over these bounds by themselves; then they start a batch of their own.
    Greedy packing depends on what came before, so jobs are dealt into lanes by user, each packed in one pass in order."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, group, n, left, batch = None, None, 0, budget, 0
        for pdf in frames:
            out = []
            for k, user, ts, cost, jobs_there, cost_there in zip(pdf["_lane"], pdf["user_id"], pdf["ts"], pdf["cost"], pdf["_jobs"], pdf["_costs"]):
                new = (user, ts) != group and (n + jobs_there > size or left < cost_there)
                if k != lane or n and (new or n >= size or left < cost):
                    lane, batch, n, left = k, (0 if k != lane else batch + 1), 0, budget
                group = (user, ts)
                out.append(f"{k}-{batch}")
                n, left = n + 1, left - cost
            yield pdf.assign(batch=out).drop(columns=["_lane", "_jobs", "_costs"])

    dealt = jobs.withColumn("_lane", F.pmod(F.xxhash64("user_id"), F.lit(lanes))).repartition("_lane")
    there = Window.partitionBy("_lane", "user_id", "ts")  # within the lanes, so nothing is shuffled again
    ordered = dealt.withColumns({"_jobs": F.count("*").over(there), "_costs": F.sum("cost").over(there)}).sortWithinPartitions("_lane", "user_id", "ts", "cost")
    return ordered.mapInPandas(pack, ", ".join(f"{n} {t}" for n, t in jobs.dtypes) + ", batch string")


def repair_rounds(ranked: DataFrame, violations: Callable[[DataFrame], DataFrame], most: int = 2) -> DataFrame:
    """Drops what violates a rule and closes the ranks, until nothing does or `most` rounds are over. violations: a list's rows at fault."""
    for _ in range(most):
        bad = violations(ranked).select("user_id", "item").distinct()
        if bad.isEmpty():
            break
        kept = ranked.join(bad, ["user_id", "item"], "left_anti")
        ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("rank")))
    return ranked
