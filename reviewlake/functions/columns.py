"""Column expressions shared by the operators: text, numbers, vectors. All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

DAY_US = 86_400_000_000

# Aspect names that count as one, by the name that stands for them.
ASPECT_SYNONYMS = {
    "build": "build quality",
    "quality": "build quality",
    "smell": "scent",
    "fragrance": "scent",
    "odor": "scent",
    "texture": "feel",
    "consistency": "feel",
    "package": "packaging",
    "price": "value",
    "cost": "value",
    "value for money": "value",
    "fit": "comfort",
}
# Fixed value: what a token is.
TOKEN = r"[a-z0-9][a-z0-9\-\+]{1,}"
SPACE_TRIM = " \t\n\u000b\f\r"


def case(value: Column, table: dict, otherwise: Column | None = None) -> Column:
    """value looked up in a small fixed table."""
    out = reduce(lambda w, kv: w.when(value == F.lit(kv[0]), F.lit(kv[1])), table.items(), F.when(F.lit(False), F.lit(next(iter(table.values())))))
    return out if otherwise is None else out.otherwise(otherwise)


def normalize_aspect(raw: Column) -> Column:
    """Trimmed, lower-case, synonyms replaced."""
    key = F.lower(F.btrim(raw, F.lit(SPACE_TRIM)))
    return case(key, ASPECT_SYNONYMS, key)


def blank_to_null(text: Column) -> Column:
    return F.when(F.btrim(text, F.lit(SPACE_TRIM)) != "", text)


def tokens(text: Column, stop: list[str] | None = None) -> Column:
    """Distinct preference tokens of a text: lower case, two characters at least, without stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)))
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else found


def hits(query: Column, doc: Column) -> Column:
    return F.size(F.array_intersect(query, doc))


def overlap(query: Column, doc: Column) -> Column:
    """Share of the query's tokens that the document has; 0 without query tokens."""
    return F.coalesce(hits(query, doc) / F.nullif(F.size(query), F.lit(0)), F.lit(0.0))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(both_empty))


def category_tokens(categories: Column) -> Column:
    """Distinct lower-case parts of a comma-separated list."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(categories), ","), lambda x: F.trim(x)), lambda x: x != ""))


def name_tokens(name: Column, most: int = 6) -> Column:
    """The first tokens of a name: 3 letters or digits at least, "/" and "-" standing for spaces."""
    parts = F.split(F.translate(F.lower(name), "/-", "  "), r"\s+")
    return F.slice(F.filter(parts, lambda x: (F.length(x) >= 3) & x.rlike("^[a-z0-9]+$")), 1, most)


def cut(text: Column, width: int) -> Column:
    """text, or its first width - 1 characters with an ellipsis."""
    return F.when(F.length(text) > width, F.concat(F.rtrim(F.substring(text, 1, width - 1)), F.lit("…"))).otherwise(text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is missing or has no length."""
    scale = norm(a) * norm(b)
    return F.coalesce(F.when((norm(a) >= 1e-12) & (norm(b) >= 1e-12), dot(a, b) / scale), F.lit(0.0))


def mix_vectors(a: Column, b: Column, alpha: float) -> Column:
    """alpha * a + (1 - alpha) * b; a alone where b is missing."""
    return F.coalesce(F.zip_with(a, b, lambda x, y: alpha * x.cast("double") + (1 - alpha) * y), F.transform(a, lambda x: x.cast("double")))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def zscore(x: Column, over: WindowSpec) -> Column:
    """Population z-score within a window's rows; 0 where they do not vary."""
    sd = F.stddev_pop(x).over(over)
    return F.when(sd < 1e-12, F.lit(0.0)).otherwise((x - F.avg(x).over(over)) / sd)


def minmax(x: Column, over: WindowSpec) -> Column:
    low, high = F.min(x).over(over), F.max(x).over(over)
    return F.when(high - low < 1e-12, F.lit(0.0)).otherwise((x - low) / (high - low))


def by(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


def rating_bucket(rating: Column) -> Column:
    return F.when(rating <= 2, "low").when(rating <= 3, "mid").otherwise("high")


def confidence(raw: Column) -> Column:
    """A model's confidence as a number from 0 to 1: percentages and words are understood, all else is 0.5."""
    words = {"high": 0.9, "medium": 0.6, "low": 0.3}
    number = F.coalesce(F.regexp_replace(raw, "%$", "").try_cast("double"), case(F.lower(F.trim(raw)), words), F.lit(0.5))
    return clamp(F.when(number > 1, number / 100).otherwise(number), 0.0, 1.0)


def iso_to_us(raw: Column) -> Column:
    """Microseconds since 1970 of "yyyy-MM-dd" with or without " HH:mm:ss", UTC; null for anything else."""
    raw = F.trim(raw)
    full = F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH:mm:ss"))
    day = F.try_to_timestamp(raw, F.lit("yyyy-MM-dd"))
    return F.unix_micros(F.coalesce(full, day))


def review_id(explicit: Column, user: Column, item: Column, ts: Column) -> Column:
    made = F.when(user.isNotNull() & item.isNotNull() & ts.isNotNull(), F.concat_ws("|", user, item, ts.cast("string")))
    return F.coalesce(blank_to_null(F.trim(explicit)), made, F.lit(""))


def hash32(*parts: Column | str) -> Column:
    """The first 32 bits of the md5 of the parts' text, joined by colons, as a number: draws that any engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")
