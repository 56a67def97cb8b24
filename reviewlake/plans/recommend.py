"""Plans: from raw rows to a split, and from a split to ranked and scored lists. Each method scores rows (user_id, item)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by, minmax
from ..functions.session import save
from ..operators import catalogue, clean, covisit, factors, metrics, protocol, ranking, sequence, signals
from ..operators.catalogue import SparseScores
from ..operators.factors import Factors

Scorer = Callable[[DataFrame], DataFrame]


def build_dataset(rows: DataFrame, k: int = 10, most_users: int | None = None, most_items: int | None = None, min_history: int = 5, low: int | None = None, high: int | None = None, dedup: bool = True, last_out: bool = False, save=None) -> DataFrame:
    """Period, earliest row per pair, k-core, caps, split."""
    rows = clean.in_period(rows, low, high)
    rows = clean.dedup_earliest(rows) if dedup else rows
    rows = clean.sample_subset(rows, k, most_users, most_items, save)
    return clean.leave_last_out(rows, min_history) if last_out else clean.chronological_split(rows, min_history=min_history)


def scorers(train: DataFrame, signal: DataFrame | None = None, queries: DataFrame | None = None, alpha: float = 0.5, rate: float = 0.01) -> dict[str, Scorer]:
    """The methods by name. Those on aspects need signals and query times."""

    def popularity(c: DataFrame) -> DataFrame:
        return c.join(ranking.popularity(train), "item", "left").select(*c.columns, F.coalesce("score", F.lit(0.0)).alias("score"))

    out: dict[str, Scorer] = {"popularity": popularity, "itemknn": lambda c: covisit.itemknn_scores(c, train), "sequential": lambda c: sequence.next_item_scores(c, train), "markov": lambda c: sequence.markov_scores(c, train)}

    out["svd"] = out["base_cf"] = lambda c: factors.factor_scores(c, factors.truncated_svd(train))
    out["als"] = lambda c: covisit.als_scores(c, train, clean.id_maps(train, column="user_id"), clean.id_maps(train))
    if signal is not None and queries is not None:
        weights = signals.decayed_weights(signal, queries, rate)
        sentiment = signals.item_sentiment(signal)
        out["aspect_aware"] = lambda c: signals.affinity_scores(c, weights, sentiment)

        def blended(c: DataFrame) -> DataFrame:
            base = covisit.itemknn_scores(c, train).withColumn("s_base", minmax(F.col("score"), by("user_id"))).drop("score")
            return signals.s_ui(base, weights, sentiment, alpha).withColumn("score", F.col("total")).select(*c.columns, "score")

        out["dynamic"] = blended
    return out


def models(train: DataFrame) -> dict[str, SparseScores]:
    """The methods that give most items a default score, for whole catalogues: popularity, itemknn, sequential, markov."""
    popular = ranking.popularity(train).select(F.lit(catalogue.PLAIN).alias("base"), "item", "score")
    flat = catalogue.flat_order(train)
    none = train.select("user_id", "item", F.lit(0.0).alias("score")).limit(0)
    follow, known = sequence.next_item_hits(train)
    return {
        "popularity": SparseScores(none, popular),
        "itemknn": SparseScores(covisit.itemknn_hits(train), flat),
        # Users whose last item never led on get popular items.
        "sequential": SparseScores(follow, popular.unionByName(catalogue.flat_order(train, base="next")), known.withColumn("base", F.lit("next"))),
        "markov": SparseScores(sequence.markov_hits(train), flat),
    }


def _factor_lists(model: Factors, goal: DataFrame, train: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """Best lists with the goal items in the running; users without a vector score 0 everywhere."""
    known = model.users.select("user_id")
    own = factors.factor_scores(goal.join(known, "user_id", "left_semi"), model)
    found = factors.factor_best(model, goal, k, seen).select("user_id", "item", "score").unionByName(own).groupBy("user_id", "item").agg(F.max("score").alias("score"))
    rest = goal.join(known, "user_id", "left_anti")
    flat = SparseScores(own.limit(0), catalogue.flat_order(train))
    return ranking.rank_by_score(found, k).unionByName(catalogue.best(catalogue.with_gold(flat, rest), rest, k, seen))


def evaluate(model: SparseScores | Factors | Scorer, train: DataFrame, test: DataFrame, ks: tuple[int, ...] = (5, 10, 20), most_users: int | None = None, block_users: int = 5000) -> DataFrame:
    """Metrics per test user over the whole catalogue, seen items left out, the user's test items always in; with most_users of
    those users only whose hash comes first.

    A SparseScores model is ranked without users times catalogue, Factors by products of blocks of vectors. A function that scores candidates needs them all: users are
    dealt into blocks of about block_users, one after the other, so that no more copies of the catalogue exist at a time.
    """
    goal = test.select("user_id", "item").distinct()
    if most_users is not None:
        keep = goal.select("user_id").distinct().orderBy(F.xxhash64("user_id"), "user_id").limit(most_users)
        goal = goal.join(keep, "user_id", "left_semi")
    if isinstance(model, SparseScores):
        seen = train.select("user_id", "item").join(goal, ["user_id", "item"], "left_anti")
        lists = catalogue.best(catalogue.with_gold(model, goal), goal, max(ks), seen)
        return metrics.rank_metrics(lists, goal, ks)
    if isinstance(model, Factors):
        seen = train.select("user_id", "item").join(goal, ["user_id", "item"], "left_anti")
        return metrics.rank_metrics(_factor_lists(model, goal, train, seen, max(ks)), goal, ks)
    blocks = -(-goal.select("user_id").distinct().count() // block_users)
    found = None
    for n in range(max(blocks, 1)):
        part = goal if blocks <= 1 else goal.where(F.pmod(F.xxhash64("user_id"), F.lit(blocks)) == n)
        rows = metrics.rank_metrics(ranking.rank_by_score(model(ranking.candidates(part, train, train, part)), max(ks)), part, ks)
        rows = rows if blocks <= 1 else save(rows, "block")
        found = rows if found is None else found.unionByName(rows)
    return found


def evaluate_sampled(scorer: Scorer, train: DataFrame, test: DataFrame, n: int = 100, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Metrics per test row against n sampled negatives."""
    pool = ranking.sampled_negatives(test.select("row_id", "user_id", "item"), train, train, n)
    ranked = ranking.top_k(scorer(pool.select("row_id", "user_id", "item")), max(ks), ["row_id"], [F.desc("score"), "item"])
    return metrics.rank_metrics(ranked, pool.where("relevant").select("row_id", "item"), ks, unit="row_id")


def evaluate_rows(train: DataFrame, test: DataFrame, scores: DataFrame | SparseScores, ks: list[int], sampled_ks: list[int] | None = None, n: int = 100, cumulative: bool = True) -> DataFrame:
    """The dual pass, per test row: pass, metric, k, value. "full" ranks among all unseen items, "sampled" against n negatives and
    at sampled_ks too; scores: item, score, the same for all users, or a model with scores of their own."""
    places = protocol.model_places if isinstance(scores, SparseScores) else protocol.unseen_places
    full = protocol.row_metrics(places(test, scores, train, cumulative), tuple(protocol.effective_ks(ks)), "full")
    pool = ranking.sampled_negatives(test.select("row_id", "user_id", "item"), train, train, n)
    return full.unionByName(protocol.row_metrics(protocol.sampled_places(pool, scores), tuple(protocol.effective_ks(ks, sampled_ks, True)), "sampled"))
