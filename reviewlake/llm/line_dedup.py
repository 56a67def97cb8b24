"""Line dedup by log templates, in DataFrame operations only.

Lines are parsed by a tree of fixed depth: the first level is the number of tokens, the next ones the leading tokens, tokens with
digits standing as variable fields. Within a leaf, a position's token is fixed if enough lines have it there and a variable
field otherwise. Lines whose template recurs across documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, narrow, parted, save

FIELD = "<*>"
TOKEN_GAP = r"[\x20\x09-\x0D]+"
#: The parameters of the registered query and of the pipeline: lines of every length, and fields in up to half of a template.
WHOLE = {"min_tokens": 1, "fixed_share": 0.5}
#: Templates without any fixed token need so large a share of fields that digits mark.
BARE_SHARE = 0.8


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(FIELD)).otherwise(t))


def parsed_lines(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """content, pos, line, leaf: the lines of at least min_tokens tokens.

    content is the MD5 of the whole text: equal texts are one content, and so one document where documents are counted.
    """
    # The text is hashed before its lines are exploded: no line carries it.
    whole = docs.select(F.md5(F.col("text").cast("binary")).alias("content"), F.split("text", "\n").alias("lines"))
    lines = whole.select("content", F.posexplode("lines").alias("pos", "line"))
    rows = lines.withColumn("line", F.btrim("line", F.lit(SPACES))).where("line <> ''")
    rows = rows.withColumn("n", F.regexp_count("line", F.lit(TOKEN_GAP)) + 1).where(F.col("n") >= min_tokens)
    # The leading tokens are all of the line before the gap after the last of them.
    head = F.regexp_extract("line", rf"^[^\x20\x09-\x0D]+(?:{TOKEN_GAP}[^\x20\x09-\x0D]+){{0,{depth - 1}}}", 0)
    leaf = F.xxhash64("n", F.array_join(_masked(F.split(head, TOKEN_GAP)), " "))
    return rows.select("content", "pos", "line", leaf.alias("leaf"))


def recurring_lines(lines: DataFrame, min_docs: int, fixed_share: float) -> DataFrame:
    """leaf, line, template of the distinct lines whose template stands in at least min_docs contents."""
    distinct = lines.groupBy("leaf", "line").agg(F.countDistinct("content").alias("n"))
    tokens = distinct.select("leaf", "line", "n", F.posexplode(_masked(F.split("line", TOKEN_GAP))).alias("at", "token"))
    support = F.sum("n").over(Window.partitionBy("leaf", "at", "token"))
    joined = tokens.withColumn("fixed", (support >= min_docs) & (F.col("token") != FIELD))
    # A field that digits mark is one by its form; only other tokens that vary count against the template.
    own = F.when(F.col("fixed"), F.col("token")).otherwise(F.lit(FIELD))
    made = joined.groupBy("leaf", "line").agg(
        F.array_sort(F.collect_list(F.struct("at", own.alias("general"), F.col("token").alias("token")))).alias("t"),
        F.avg((F.col("fixed") | (F.col("token") == FIELD)).cast("int")).alias("share"),
    )
    # One or two tokens with digits, and nothing fixed beside them, have no form in common: such lines stand for themselves.
    said = F.exists("t.general", lambda x: x != FIELD)
    general = (F.col("share") >= fixed_share) & (said | (F.col("share") >= BARE_SHARE))
    template = F.array_join(F.when((F.size("t") < 3) & ~said, F.split("line", TOKEN_GAP)).when(general, F.col("t.general")).otherwise(F.col("t.token")), " ")
    made = made.select("leaf", "line", template.alias("template"))
    # Distinct first, dealt by content too, so that a hot template's contents are not gathered in one task.
    enough = lines.join(made, ["leaf", "line"]).select("leaf", "template", "content").distinct().groupBy("leaf", "template").agg(F.count("*").alias("contents")).where(F.col("contents") >= min_docs)
    return made.join(enough, ["leaf", "template"])


def _mask(drops: Column) -> Column:
    """Ascending positions as bytes, 1 at each of them and 0 before: a byte is found at once, where an array would be searched."""
    before = lambda i: F.when(i == 0, -1).otherwise(F.get(drops, i - 1))
    parts = F.transform(F.sequence(F.lit(0), F.size(drops) - 1), lambda i: F.concat(F.repeat(F.lit("0"), F.get(drops, i) - before(i) - 1), F.lit("1")))
    return F.array_join(parts, "").cast("binary")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 30, depth: int = 3, min_tokens: int = 3, fixed_share: float = 0.8, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, text, n_lines, n_dropped; text is the original text without its dropped lines.

    Lines end at line feeds and are compared without white space at their ends. A line is dropped, wherever it stands, if its
    template stands in at least min_docs documents, whatever lines are around it. Equal texts count as one document, however
    many they are, and so does a template that one document repeats. Lines with fewer than min_tokens tokens stay. A template may have variable fields
    in a share of 1 - fixed_share of its tokens, besides tokens with digits; a line that would need more is its own template. So
    is one of one or two tokens that all have digits, and one whose words would all be fields, unless digits mark most of it.
    Null texts count as empty and stay empty, with one empty line; texts that lose all their lines become empty. Rows
    repeated with the same id are treated alike. Columns named in carry come along as they are; others are left out.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("_carry"))
    parsed = save(parsed_lines(rows, depth, min_tokens), "parsed")  # parsing is most of the work
    # Few leaves stand in min_docs documents at all; only their lines are shuffled and parsed further.
    busy = save(parsed.select("leaf", "content").distinct().groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf"), "busy")
    lines = save(narrow(parsed, busy, "leaf").join(busy, "leaf", "left_semi"), "lines")
    found = recurring_lines(lines, min_docs, fixed_share)
    drops = save(lines.join(found, ["leaf", "line"], "left_semi").groupBy("content").agg(F.array_sort(F.collect_set("pos")).alias("drops")).select("content", _mask(F.col("drops")).alias("drops"), F.size("drops").alias("n_dropped")), "drops")
    # Only texts that lose lines are shuffled.
    maybe, never = parted(rows.withColumn("content", F.md5(F.col("text").cast("binary"))), drops, "content")
    out = maybe.join(drops, "content", "left").unionByName(never.withColumns({"drops": F.lit(None).cast("binary"), "n_dropped": F.lit(None).cast("int")}))
    out = out.withColumn("_lines", F.split("text", "\n"))
    kept = F.array_join(F.filter("_lines", lambda x, i: F.substring("drops", i + 1, F.lit(1)) != F.lit(b"1")), "\n")
    more = [F.col("_carry").getField(c).alias(c) for c in carry]
    return out.select("doc_id", F.when(F.col("drops").isNull(), F.col("text")).otherwise(kept).alias("text"), F.size("_lines").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), *more)
