"""Sources: line-delimited reviews and metadata, typed TSV files, and the tables that jobs leave behind.

Everything is read by Spark with a fixed schema, so nothing is scanned to infer one, columns are pruned and filters pushed down.
Times are microseconds since 1970; sources in milliseconds or seconds are converted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, iso_to_us, review_id

REVIEW = (
    "user_id string, parent_asin string, asin string, rating double, timestamp long, helpful_vote int, verified_purchase boolean, text string, reviewText string, review_text string, "
    "title string, review_id string, business_id string, stars double, date string, useful int, _bad string"
)
META = "parent_asin string, asin string, title string, main_category string, categories array<string>, average_rating double, rating_number long, store string, description array<string>, _bad string"
BUSINESS = "business_id string, name string, city string, state string, categories string, stars double, review_count long, _bad string"
INTERACTION = "user_id string, item string, rating double, timestamp long, helpful_vote int, verified_purchase boolean"
TRIPLES = "array<struct<aspect:string,opinion:string,sentiment:string,confidence:double>>"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a line-delimited file or folder; blank, broken and other lines are left out. row_id follows the file's order
    within a partition and stays the same for the same files."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true").json(path)
    return rows.withColumn("row_id", F.monotonically_increasing_id()).where("_bad is null").drop("_bad")


def normalized_reviews(raw: DataFrame) -> DataFrame:
    """One shape for retail and venue reviews: review_id, user_id, item, rating, ts, helpful_vote, verified, title, text, row_id.

    Rows with a business_id and stars or a date are venue reviews. Rows without user, item, rating or time are left out.
    """
    venue = F.col("business_id").isNotNull() & (F.col("stars").isNotNull() | F.col("date").isNotNull())
    pick = lambda a, b: F.when(venue, a).otherwise(b)
    rows = raw.select(
        "review_id", blank_to_null(F.col("user_id")).alias("user_id"), pick(F.col("business_id"), F.coalesce(blank_to_null(F.col("parent_asin")), blank_to_null(F.col("asin")))).alias("item"),
        pick(F.col("stars"), F.col("rating")).alias("rating"), pick(iso_to_us(F.col("date")), F.col("timestamp") * 1000).alias("ts"), F.coalesce(pick(F.col("useful"), F.col("helpful_vote")), F.lit(0)).alias("helpful_vote"),
        F.coalesce(pick(F.lit(False), F.col("verified_purchase")), F.lit(False)).alias("verified"), F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(blank_to_null(F.col("text")), blank_to_null(F.col("reviewText")), blank_to_null(F.col("review_text"))).alias("text"), "row_id",
    ).where("user_id is not null and item is not null and rating is not null and ts is not null")
    return rows.withColumn("review_id", review_id(F.col("review_id"), F.col("user_id"), F.col("item"), F.expr("ts div 1000")))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return normalized_reviews(json_lines(spark, path, REVIEW))


def interactions(reviews: DataFrame, most: int | None = None) -> DataFrame:
    """The six columns of an interaction and row_id; `most`: only the first rows in file order."""
    rows = reviews.select("user_id", "item", "rating", "ts", "helpful_vote", "verified", "row_id")
    return rows if most is None else rows.orderBy("row_id").limit(most)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """A split part in line-delimited form; what older files lack is 0 or false."""
    rows = json_lines(spark, path, INTERACTION + ", _bad string")
    filled = rows.na.fill({"rating": 0.0, "timestamp": 0, "helpful_vote": 0, "verified_purchase": False})
    return filled.select("user_id", "item", "rating", (F.col("timestamp") * 1000).alias("ts"), "helpful_vote", F.col("verified_purchase").alias("verified"), "row_id")


TYPED_ALIASES = {"user_id": ("user_id",), "item": ("item_id", "business_id"), "rating": ("rating", "stars"), "ts": ("timestamp", "date"), "helpful_vote": ("useful",)}


def typed_header(line: str) -> list[str]:
    """The names of a header of name:type cells."""
    names = [c.split(":")[0].strip() for c in line.rstrip("\r\n").split("\t")]
    if not all(names):
        raise ValueError(f"a header cell is empty: {line!r}")
    return names


def read_typed_tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, named without their types."""
    head = spark.read.text(path).first()
    names = typed_header(head[0] if head else "")
    rows = spark.read.option("sep", "\t").option("header", "true").option("quote", "").schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    return rows.withColumn("row_id", F.monotonically_increasing_id())


def read_typed_interactions(spark: SparkSession, path: str, low_s: float | None = None, high_s: float | None = None) -> DataFrame:
    """Interactions of a typed TSV file, times in seconds, within [low_s, high_s]; rows that do not parse are left out."""
    raw = read_typed_tsv(spark, path)

    def column(name: str) -> Column:
        found = [c for c in TYPED_ALIASES[name] if c in raw.columns]
        if not found and name != "helpful_vote":
            raise ValueError(f"no column for {name} among {raw.columns}")
        return F.col(found[0]) if found else F.lit(None).cast("string")

    seconds = column("ts").try_cast("double")
    rows = raw.where(F.coalesce(seconds >= F.lit(low_s if low_s is not None else float("-inf")), F.lit(False)) & (seconds <= F.lit(high_s if high_s is not None else float("inf"))))
    rows = rows.select(
        blank_to_null(column("user_id")).alias("user_id"), blank_to_null(column("item")).alias("item"), column("rating").try_cast("double").alias("rating"), (F.floor(seconds * 1000) * 1000).cast("long").alias("ts"),
        F.coalesce(column("helpful_vote").try_cast("double").cast("int"), F.lit(0)).alias("helpful_vote"), F.lit(False).alias("verified"), "row_id",
    )
    return rows.where("user_id is not null and item is not null and rating is not null")


def business_meta(raw: DataFrame) -> DataFrame:
    """Venues as items: item, name, categories (a list), main_category, store (the city), row_id."""
    cats = F.filter(F.transform(F.split(F.coalesce("categories", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = raw.where(blank_to_null(F.col("business_id")).isNotNull()).withColumn("_c", cats)
    return rows.select(F.col("business_id").alias("item"), F.coalesce("name", F.lit("")).alias("name"), F.col("_c").alias("categories"), F.coalesce(F.get("_c", F.lit(0)), F.lit("Yelp")).alias("main_category"), F.col("city").alias("store"), "stars", "review_count", "row_id")


def read_meta(spark: SparkSession, path: str, keep: DataFrame | None = None) -> DataFrame:
    """item, name, categories (one text). With keep (item) only those, and of repeated items the first row; without, the last."""
    if path.rstrip("/").endswith(".item"):
        raw = read_typed_tsv(spark, path)
        rows = raw.select(F.col("item_id").alias("item"), F.col("item_name").alias("name"), F.regexp_replace("categories", r"\\/", "/").alias("categories"), *(c for c in ("city", "state") if c in raw.columns), "row_id")
    else:
        raw = json_lines(spark, path, META)
        text = F.array_join(F.array_distinct(F.filter("categories", lambda c: F.trim(c) != "")), ", ")
        rows = raw.select(F.coalesce(blank_to_null(F.col("parent_asin")), blank_to_null(F.col("asin"))).alias("item"), F.coalesce("title", F.lit("")).alias("name"), F.coalesce(blank_to_null(text), F.col("main_category"), F.lit("")).alias("categories"), "row_id")
    rows = rows.where("item is not null")
    others = F.struct(*(c for c in rows.columns if c not in ("item", "row_id")))
    if keep is not None:
        rows = rows.join(keep.select("item").distinct(), "item", "left_semi")
    chosen = (F.max_by if keep is None else F.min_by)(others, "row_id").alias("_m")
    return rows.groupBy("item").agg(chosen).select("item", "_m.*")


def read_triples(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """review_id, triples from lines with a list of triples; strict: any other line fails the read (gold files)."""
    if strict:
        return spark.read.schema(f"review_id string, triples {TRIPLES}").option("mode", "FAILFAST").json(path)
    return json_lines(spark, path, f"review_id string, triples {TRIPLES}, _bad string").drop("row_id")


def import_triple_cache(rows: DataFrame) -> DataFrame:
    """rows: review_id, triples_json, as a key-value store exports them."""
    return rows.select("review_id", F.from_json("triples_json", TRIPLES).alias("triples"))


def read_targets(spark: SparkSession, path: str, ids: DataFrame | None = None, errors: DataFrame | None = None, done: DataFrame | None = None) -> DataFrame:
    """review_id, text; blank ids and texts left out. With ids (review_id) only those; with errors (review_id, the log of a run that
    failed for some) only those, to try them again; without those that are in done (review_id) already."""
    rows = json_lines(spark, path, "review_id string, text string, _bad string")
    rows = rows.where("trim(coalesce(review_id, '')) <> '' and trim(coalesce(text, '')) <> ''")
    for keep in (ids, errors):
        if keep is not None:
            rows = rows.join(keep.select("review_id").distinct(), "review_id", "left_semi")
    return rows if done is None else rows.join(done.select("review_id"), "review_id", "left_anti")


def review_texts(reviews: DataFrame) -> DataFrame:
    """user_id, item, ts, text; of repeated keys the last row, no blank texts and no rows without a time."""
    rows = reviews.where("ts <> 0 and trim(coalesce(text, '')) <> ''")
    return rows.groupBy("user_id", "item", "ts").agg(F.max_by("text", "row_id").alias("text"))


def read_preference_texts(spark: SparkSession, path: str) -> DataFrame:
    """user_id, ts, text, has_reviews; the last line of each key."""
    rows = json_lines(spark, path, "user_id string, query_ts_ms long, T_u string, has_reviews boolean, _bad string")
    last = F.max_by(F.struct(F.coalesce("T_u", F.lit("")).alias("text"), F.coalesce("has_reviews", F.lit(True)).alias("has_reviews")), "row_id").alias("_l")
    return rows.groupBy("user_id", (F.col("query_ts_ms") * 1000).alias("ts")).agg(last).select("user_id", "ts", "_l.*")


def covisit_from_json(raw: DataFrame, column: str = "value") -> DataFrame:
    """anchor, co, n out of nested maps of counts."""
    maps = raw.select(F.explode(F.from_json(column, "map<string,map<string,long>>")).alias("anchor", "to")).where("to is not null")
    return maps.select("anchor", F.explode("to").alias("co", "n"))


def covisit_to_json(edges: DataFrame) -> DataFrame:
    """anchor, co, n as rows of value, a nested map each: what covisit_from_json() reads. A row for each anchor, the others in order."""
    to = F.map_from_entries(F.array_sort(F.collect_list(F.struct("co", "n"))))
    return edges.groupBy("anchor").agg(to.alias("to")).select(F.to_json(F.create_map("anchor", "to")).alias("value"))


def read_vectors(spark: SparkSession, path: str, dimensions: dict[str, int] | None = None) -> DataFrame:
    """kind, key, vector: exported embeddings of any model. With dimensions (kind to length) the table is held against it:
    ValueError for a kind that is missing or unknown, a vector of another length, or a key that a kind has twice."""
    rows = spark.read.schema("kind string, key string, vector array<float>").parquet(path)
    if dimensions is None:
        return rows
    keys = rows.groupBy("kind", "key").agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high"))
    found = {r.kind: r for r in keys.groupBy("kind").agg(F.max("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    wrong = sorted({str(k) for k in {*found} ^ {*dimensions}} | {str(k) for k, r in found.items() if r.n > 1 or {r.low, r.high} != {dimensions.get(k)}})
    if wrong:
        raise ValueError(f"{path} does not hold what was asked for: {', '.join(wrong)}")
    return rows


def signals_from_triples(index: DataFrame, triples: DataFrame, helpful: DataFrame | None = None) -> DataFrame:
    """index: review_id, user_id, item, ts; triples: review_id, triples; helpful: user_id, item, ts, helpful_vote. The signals
    user_id, item, aspect, polarity, helpful, ts, row_id; reviews without triples have none."""
    from ..functions.columns import case, normalize_aspect

    rows = index.join(triples.where(F.size("triples") > 0), "review_id").select("review_id", "user_id", "item", "ts", F.posexplode("triples").alias("_p", "_t"))
    polarity = case(F.lower("_t.sentiment"), {"positive": 1.0, "negative": -1.0, "neutral": 0.0}, F.lit(0.0))
    out = rows.select("user_id", "item", normalize_aspect(F.col("_t.aspect")).alias("aspect"), polarity.alias("polarity"), "ts", F.xxhash64("review_id", "_p").alias("row_id"))
    if helpful is None:
        return out.withColumn("helpful", F.lit(0))
    votes = helpful.groupBy("user_id", "item", "ts").agg(F.max("helpful_vote").alias("helpful"))
    return out.join(votes, ["user_id", "item", "ts"], "left").na.fill(0, ["helpful"])
