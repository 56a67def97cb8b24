"""Text of items, reviews and preferences: cards, snippets, templates; and reading of models' JSON answers."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import confidence, cut, hits, overlap, tokens
from .ranking import top_k

# Words that say nothing about a preference.
STOP_WORDS = (
    "the", "and", "for", "with", "this", "that", "from", "have", "has", "was", "were", "are", "is", "been", "being", "but", "not", "you", "your",
    "my", "me", "we", "our", "they", "their", "its", "a", "an", "of", "in", "on", "to", "as", "at", "by", "or", "if", "so", "it", "be", "do", "does",
    "did", "will", "would", "can", "could", "should", "very", "just", "also", "into", "over", "after", "than", "then", "too", "all", "any", "more",
    "most", "some", "such", "no", "nor", "only", "own", "same", "other", "about", "up", "out", "off", "again", "further", "once", "here", "there",
    "when", "where", "why", "how", "what", "which", "who", "whom", "i", "he", "she", "him", "her", "them", "product", "products", "item", "items",
    "like", "likes", "love", "loves", "want", "wants", "need", "needs", "prefer", "prefers", "use", "uses", "using", "used", "good", "great",
    "really", "amazon",
)


def preference_tokens(text: Column) -> Column:
    return tokens(text, STOP_WORDS)


def query_tokens(t_u: Column, facts: list[Column] | None = None) -> Column:
    """Tokens of a preference text and of further fields."""
    return F.array_distinct(F.concat(preference_tokens(t_u), *[preference_tokens(f) for f in facts or []]))


def overlap_text(meta: DataFrame) -> Column:
    return F.concat_ws(" ", *[c for c in ("name", "categories", "snippet") if c in meta.columns])


def with_item_tokens(meta: DataFrame) -> DataFrame:
    return meta.withColumn("item_tokens", preference_tokens(overlap_text(meta)))


def card(item: Column, name: Column, categories: Column, score: Column | None = None, max_cats: int = 3, max_name: int = 40) -> Column:
    """item | S=0.0000 | name=... | cats=..., shortened with ellipses; missing parts are left out."""
    cats = F.array_join(F.slice(F.transform(F.split(categories, ","), lambda x: F.trim(x)), 1, max_cats), ", ")
    parts = [item] + ([F.format_string("S=%.4f", score)] if score is not None else [])
    parts += [F.when(F.trim(name) != "", F.concat(F.lit("name="), cut(F.trim(name), max_name))), F.when(F.trim(categories) != "", F.concat(F.lit("cats="), cats))]
    return F.concat_ws(" | ", *parts)


def card_budget(n: Column) -> list[Column]:
    """max_name, max_cats, max_review_chars by the number of cards."""
    tier = lambda a, b, c: F.when(n <= 40, a).when(n <= 100, b).otherwise(c)
    return [tier(80, 60, 40).alias("max_name"), tier(5, 4, 3).alias("max_cats"), tier(100, 60, 0).alias("max_review_chars")]


def item_snippets(reviews: DataFrame, allowed: DataFrame | None = None, per_item: int = 1, width: int = 100) -> DataFrame:
    """item, nth, snippet: the first reviews of each item (of allowed (user_id, item, ts) only), white space folded, cut."""
    rows = reviews if allowed is None else reviews.join(allowed.select("user_id", "item", "ts"), ["user_id", "item", "ts"], "left_semi")
    rows = rows.withColumn("snippet", cut(F.trim(F.regexp_replace("text", r"\s+", " ")), min(2 * width, 280))).where("snippet <> ''")
    return top_k(rows, per_item, ["item"], ["row_id"]).select("item", F.col("rank").alias("nth"), "snippet")


def best_snippet(rows: DataFrame, max_chars: int = 100) -> DataFrame:
    """rows: user_id, item, nth, snippet, query_tokens. user_id, item, snippet: the one that shares most with the query, the first of equals."""
    score = overlap(F.col("query_tokens"), preference_tokens(F.col("snippet")))
    best = F.max_by(F.col("snippet"), F.struct(score.alias("s"), (-F.col("nth")).alias("n"))).alias("snippet")
    return rows.groupBy("user_id", "item").agg(best).withColumn("snippet", cut(F.col("snippet"), max_chars))


def summarize(text: Column, query: Column, max_chars: int = 100) -> Column:
    """The one or two clauses that share most with the query, in the text's order, cut."""
    clauses = F.filter(F.transform(F.split(text, r"[.!?;\n]+"), lambda c: F.trim(c)), lambda c: c != "")
    scored = F.transform(clauses, lambda c, i: F.struct((-hits(query, preference_tokens(c))).alias("s"), i.alias("i"), c.alias("c")))
    two = F.slice(F.sort_array(scored), 1, 2)
    ordered = F.transform(F.sort_array(F.transform(two, lambda x: F.struct(x["i"].alias("i"), x["c"].alias("c")))), lambda x: x["c"])
    return cut(F.array_join(ordered, ". "), max_chars)


def template_text(weights: DataFrame, rows: DataFrame) -> DataFrame:
    """user_id, text: what a user looks for, from the three top aspects and the last three items."""
    top = top_k(weights.select("user_id", "aspect", "weight"), 3, ["user_id"], [F.desc("weight"), "aspect"])
    aspects = top.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.format_string("%s (%.2f)", "aspect", "weight").alias("t")))), lambda x: x["t"]), ", ").alias("a"))
    recent = top_k(rows, 3, ["user_id"], [F.desc("ts"), F.desc("item"), F.desc("row_id")])
    items = recent.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("rank")).alias("r"), "item"))), lambda x: x["item"]), ", ").alias("i"))
    text = F.concat(F.lit("User currently prioritizes "), F.coalesce("a", F.lit("general products")), F.lit(" based on recent reviews for items "), F.coalesce("i", F.lit("none")), F.lit("."))
    return rows.select("user_id").distinct().join(aspects, "user_id", "left").join(items, "user_id", "left").select("user_id", text.alias("text"))


def category_profile(rows: DataFrame, meta: DataFrame, k: int = 5) -> DataFrame:
    """user_id, category, n, rank: the most frequent categories of a user's items (ties by name)."""
    c = rows.join(meta.select("item", F.explode(F.filter(F.transform(F.split("categories", ","), lambda x: F.trim(x)), lambda x: x != "")).alias("category")), "item")
    return top_k(c.groupBy("user_id", "category").agg(F.count("*").alias("n")), k, ["user_id"], [F.desc("n"), "category"])


def rationale(parts: DataFrame, k: int = 3) -> DataFrame:
    """parts: user_id, item, aspect, part. user_id, item, drivers, text: the k aspects that drive an item, in words."""
    top = top_k(parts, k, ["user_id", "item"], [F.desc("part"), "aspect"])
    drivers = F.sort_array(F.collect_list(F.struct("rank", "aspect", "part")))
    said = F.array_join(F.transform(drivers, lambda d: F.format_string("%s (+%.3f)", d["aspect"], d["part"])), ", ")
    return top.groupBy("user_id", "item").agg(F.transform(drivers, lambda d: d["aspect"]).alias("drivers"), F.concat(F.lit("Recommended for "), said, F.lit(".")).alias("text"))


def lookup_hints(anchors: DataFrame, pool: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """user_id, anchor, co, n, rank: the strongest edges from a user's items into the pool, per anchor."""
    met = anchors.select("user_id", F.col("item").alias("anchor")).distinct().join(edges, "anchor").join(pool.select("user_id", F.col("item").alias("co")), ["user_id", "co"], "left_semi")
    return top_k(met, most, ["user_id", "anchor"], [F.desc("n"), "co"])


def hash_vector(text: Column, dim: int, seed: int = 42) -> Column:
    """Signed feature hashing of a text's words by MD5, as a map of dimension to value, of length 1. Only the last 16 hex digits
    of a digest decide: dim must divide 2 ** 64, as powers of two do."""
    if dim & (dim - 1):
        raise ValueError("dim must be a power of two")
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    low = F.transform(words, lambda w: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), w).cast("binary")), -8, 8), 16, 10).cast("long"))
    signed = F.transform(low, lambda h: F.struct((h % dim).alias("d"), F.when(F.shiftright(h, 1) % 2 == 1, 1.0).otherwise(-1.0).alias("s")))
    dims = F.array_distinct(F.transform(signed, lambda x: x["d"]))
    sums = F.transform(dims, lambda d: F.struct(d.alias("d"), F.aggregate(F.filter(signed, lambda x: x["d"] == d), F.lit(0.0), lambda a, x: a + x["s"]).alias("s")))
    length = F.sqrt(F.aggregate(sums, F.lit(0.0), lambda a, x: a + x["s"] * x["s"]))
    return F.map_from_entries(F.transform(F.filter(sums, lambda x: x["s"] != 0), lambda x: F.struct(x["d"].alias("k"), (x["s"] / length).alias("v"))))


def strip_fences(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```[^\n]*\n?", ""), r"\n?```\s*$", ""))


def ranked_ids(raw: Column, pool: Column) -> Column:
    """Ids of the pool in the order in which a (perhaps cut off) ranking answer quotes them, then the rest of the pool."""
    text = strip_fences(raw)
    after = F.when(F.instr(text, '"ranked_item_ids"') > 0, F.substring_index(text, '"ranked_item_ids"', -1)).otherwise(text)
    quoted = F.array_distinct(F.transform(F.regexp_extract_all(after, F.lit(r'"([^"\\]{1,32})"'), F.lit(1)), lambda x: F.trim(x)))
    known = F.filter(quoted, lambda x: F.array_contains(pool, x))
    return F.concat(known, F.array_except(pool, known))


def partial_triples(raw: Column) -> Column:
    """Whole objects with an aspect and a sentiment out of a cut-off answer: array of (aspect, opinion, sentiment, confidence)."""
    shape = "struct<aspect:string,opinion:string,sentiment:string,confidence:string>"
    objects = F.transform(F.regexp_extract_all(raw, F.lit(r"\{[^{}]+\}"), F.lit(0)), lambda x: F.from_json(x, shape))
    full = F.filter(objects, lambda t: t.isNotNull() & (t["aspect"] != "") & (t["sentiment"] != ""))
    return F.transform(full, lambda t: F.struct(F.lower(F.trim(t["aspect"])).alias("aspect"), t["opinion"].alias("opinion"), F.lower(F.trim(t["sentiment"])).alias("sentiment"), confidence(t["confidence"]).alias("confidence")))


def coerce_triples(found: Column, most: int = 24) -> Column:
    """Triples with aspect, opinion and a known sentiment, each once, at most `most`."""
    ok = F.filter(found, lambda t: (F.trim(F.coalesce(t["opinion"], F.lit(""))) != "") & t["sentiment"].isin("positive", "negative", "neutral"))
    return F.slice(F.array_distinct(ok), 1, most)


def prompt_echo(raw: Column) -> Column:
    """Whether an answer repeats its instructions instead of following them."""
    return F.lower(raw).rlike(r"(return only|respond with|output format|json schema|you are an? )")


def _repair(raw: str) -> str | None:
    """The first JSON object of an answer as strict JSON, or None: fences off, typographic quotes straightened, trailing commas
    dropped, and what was cut off closed. Reads the answer once, keeping the open brackets."""
    raw = re.sub("[“”]", '"', raw.strip())
    start = raw.find("{")
    if start < 0:
        return None
    out, open_, inside, skip, safe = [], [], False, False, None
    for ch in raw[start:]:
        out.append(ch)
        if inside:
            inside, skip = not (ch == '"' and not skip), ch == "\\" and not skip
        elif ch == '"':
            inside = True
        elif ch in "{[":
            open_.append("}" if ch == "{" else "]")
        elif ch in "}]" and open_:
            open_.pop()
            if not open_:
                break
        elif ch == "," and not inside:
            safe = (len(out) - 1, list(open_))
    for text, closing in (("".join(out) + '"' * inside, open_), ("".join(out[: safe[0]]) if safe else "", safe[1] if safe else [])):
        text = re.sub(r",\s*([}\]])", r"\1", text.rstrip().rstrip(",") + "".join(reversed(closing)))
        try:
            found = json.loads(text)
            return json.dumps(found) if isinstance(found, dict) else None
        except ValueError:
            continue
    return None


def tolerant_json(rows: DataFrame, column: str, out: str = "json") -> DataFrame:
    """Adds the answer's JSON object as strict JSON, for from_json; null where there is none. A scanner with state, so Python, in batches."""

    @F.pandas_udf("string")
    def repair(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: _repair(x) if isinstance(x, str) else None)

    return rows.withColumn(out, repair(F.col(column)))


def resolve_prefix(mentioned: DataFrame, pool: DataFrame, least: int = 4) -> DataFrame:
    """mentioned: user_id, mention; pool: user_id, item. user_id, mention, item: the item itself, or the only one of the user's
    pool that begins with the mention (of `least` characters)."""
    met = mentioned.join(pool.select("user_id", "item"), "user_id").where((F.col("item") == F.col("mention")) | ((F.length("mention") >= least) & F.col("item").startswith(F.col("mention"))))
    exact = F.max(F.when(F.col("item") == F.col("mention"), F.col("item")))
    return met.groupBy("user_id", "mention").agg(F.coalesce(exact, F.when(F.count_distinct("item") == 1, F.first("item"))).alias("item")).where("item is not null")


def parallel_triples(aspects: Column, sentiments: Column, confidences: Column) -> Column:
    """Triples from a tagger's parallel arrays; a missing confidence is 0.75."""
    z = F.arrays_zip(aspects.alias("a"), sentiments.alias("s"), confidences.alias("c"))
    return F.transform(z, lambda x: F.struct(x["a"].alias("aspect"), F.lower(x["s"]).alias("sentiment"), F.coalesce(x["c"].cast("double"), F.lit(0.75)).alias("confidence")))


def preference_key(user: Column, ts: Column) -> Column:
    return F.concat_ws("|", user, ts.cast("string"))


def nested_categories(raw: Column) -> Column:
    """A list of lists as one text: each category once, in order."""
    return F.array_join(F.array_distinct(F.flatten(raw)), ", ")


def first_n_reviews(rows: DataFrame, n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("item").orderBy("row_id"))).where(F.col("_n") <= n).drop("_n")


def with_overlap(cards: DataFrame, displaced: DataFrame) -> DataFrame:
    """cards: user_id, item, card, hits; displaced: user_id, item, hits, the items that a promotion would push down. The cards with
    " | ov=own/displaced" at their end: the item's hits and the most that a displaced one has, 0 if there are none. Users without
    query tokens, all hits being null, keep their cards as they are."""
    most = displaced.groupBy("user_id").agg(F.max("hits").alias("_most"))
    note = F.concat(F.col("card"), F.lit(" | ov="), F.col("hits").cast("string"), F.lit("/"), F.coalesce("_most", F.lit(0)).cast("string"))
    return cards.join(most, "user_id", "left").withColumn("card", F.coalesce(note, F.col("card"))).drop("_most")
