"""Exact duplicates: rows grouped by a 128-bit hash of their normalised text, texts compared inside the groups.

The hash is the first half of a text's SHA-256. Narrow rows (doc_id, hash) are grouped with map-side combine; the
texts travel once, as grouping keys beside their hash, so every task sends a text of many copies once and the grouping itself
compares bytes. Hashes that stand for several texts (none, as far as anybody knows) have their rows
grouped by the text. Groups with more than a thousandth of all rows are fewer than 1000, so their classes are broadcast and
no key of the join back to the rows holds more than that share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import join_classes, saved

# runs that are not one plain space already; replacing them gives the text that replacing all runs gives
UNEVEN_SPACE = r"[ \t-\r]{2,}|[\t-\r]"


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), UNEVEN_SPACE, " ")


def content_hash(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def first_row() -> Column:
    """The place of the row that stays: smallest doc_id, rows without one last, of equal ones the first written."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")


def classes_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("group_size"), F.min(first_row()).alias("_first"))


def result(joined: DataFrame) -> DataFrame:
    return joined.select("doc_id", F.col("_first.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_first._row")).alias("kept"),
                         F.lower(F.hex("_sha")).alias("text_sha256"))


def exact_duplicates(docs: DataFrame, normal: Callable[[Column], Column] = normalised, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs`` (doc_id, text and any others).

    Texts are equal when ``normal`` makes them identical, whatever ``digest`` says. One row of every group is kept, the one with
    the smallest doc_id (``keep_id``): rows without doc_id come last (``keep_id`` is null in a group that has only such rows),
    and of rows that repeat a doc_id and a text only one is kept. Null texts are empty texts, one group. An empty table gives no rows;
    other columns are ignored.
    """
    text = docs.select("doc_id", normal(F.col("text")).alias("_text"))
    rows = saved(text.select(F.monotonically_increasing_id().alias("_row"), "doc_id", digest(F.col("_text")).alias("_h"), F.unhex(F.sha2("_text", 256)).alias("_sha")))
    compared = text.select(digest(F.col("_text")).alias("_h"), "_text").groupBy("_h", "_text").agg(F.lit(1).alias("_one"))
    collided = saved(compared.groupBy("_h").agg(F.count("*").alias("_n")).filter("_n > 1").select("_h"))
    if not collided.isEmpty():
        hit = saved(text.withColumn("_h", digest(F.col("_text"))).join(collided, "_h", "left_semi").withColumn("_row", F.monotonically_increasing_id()))
        by_text = result(hit.withColumn("_sha", F.unhex(F.sha2("_text", 256))).join(classes_of(hit, ["_h", "_text"]), ["_h", "_text"]))
        rows = saved(rows.join(collided, "_h", "left_anti"))
    found = result(join_classes(rows, saved(classes_of(rows, ["_h"])), "_h", "group_size"))
    return found if collided.isEmpty() else found.unionByName(by_text)


def without_duplicates(docs: DataFrame, normal: Callable[[Column], Column] = normalised) -> DataFrame:
    """One whole row of every group of equal texts, with all its columns: the smallest doc_id's, rows without doc_id last.

    The text itself is the key. Of rows that repeat a doc_id and a text the smallest in their other columns' order stays.
    """
    def free(name: str) -> str:  # callers' columns keep their names and values
        return name if name not in docs.columns else free("_" + name)

    key, row = free("key"), free("row")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.struct(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))
    kept = docs.groupBy(normal(F.col("text")).alias(key)).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias(row))
    return kept.select(f"{row}.*")
