"""A corpus pipeline on ``documents``: each stage is written as Parquet and read by the next.

Every stage takes documents (doc_id, text, any others) and works on all its predecessor kept. Callers' columns stay as they are,
whatever their names; rows that repeat, null doc_ids and null texts have a defined result, stated in each stage. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import encode
from tidemark.llm.decontamination import with_items
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.near_dup import near_duplicates
from tidemark.llm.queries import table, tokenizer_file
from tidemark.llm.shared import free_names, saved
from tidemark.llm.toxicity import CUTOFF, with_score


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cutoff. Null and empty texts have the score of the bias alone and stay; equal texts go or stay together."""
    name, = free_names(docs.columns, "score")
    return with_score(docs, table(spark, sf_dir, "labels"), name=name).filter(F.col(name) < CUTOFF).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of three-line runs; a document of nothing else goes. ``n_chars``, if there, follows the text.

    Null texts, and texts of fewer than three lines, stay as they are. Rows without doc_id come after all others. Rows that
    repeat a doc_id and a text count as one document here, and all stay (the near-dedup stage drops them).
    """
    n_lines, n_removed = free_names(docs.columns, "n_lines", "n_removed")
    out = dedup_lines(docs).filter((F.col(n_removed) == 0) | (F.col(n_removed) < F.col(n_lines)))
    if "n_chars" in docs.columns:
        n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col(n_removed) > 0, n_chars).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the one of the smallest doc_id.

    Rows without doc_id take part under a name from their text, above all ids, so they go where a copy has a doc_id. Of rows
    that repeat a doc_id (or have none) and a text one stays. Rows that share a doc_id and have
    different texts stay or go together, as one document. Null and empty texts are near nothing, but repeat one another where they share a doc_id.
    """
    named_id, digest = free_names(docs.columns, "named_id", "digest")
    text = F.coalesce("text", F.lit(""))
    unnamed = F.shiftrightunsigned(F.xxhash64(text), 2) + F.lit(1 << 62)
    named = docs.withColumn(named_id, F.coalesce(F.col("doc_id").cast("long"), unnamed))
    others = near_duplicates(named.select(F.col(named_id).alias("doc_id"), "text")).filter("not kept").select(F.col("doc_id").alias(named_id)).distinct()
    kept = named.join(others, named_id, "left_anti").withColumn(digest, F.unhex(F.sha2(text, 256)))
    repeated = saved(kept.groupBy(named_id, digest).agg(F.count("*").alias("n")).filter("n > 1").select(named_id, digest))
    if not repeated.isEmpty():
        twice = kept.join(repeated, [named_id, digest], "left_semi").dropDuplicates([named_id, digest])
        kept = kept.join(repeated, [named_id, digest], "left_anti").unionByName(twice)
    return kept.select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages. Null and empty texts hold none and stay; equal texts go or stay together."""
    name, = free_names(docs.columns, "items")
    return with_items(docs, table(spark, sf_dir, "benchmark"), docs.columns, name).filter(F.size(name) == 0).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids beside the decoded text, a row for every row; null and empty texts have no tokens."""
    return encode(docs, tokenizer_file(), [c for c in ("doc_id", "lang", "source", "n_chars") if c in docs.columns])


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("bpe", tokenize),
]

ORACLE_SQL = None  # toxicity, retrieval and merges have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
