"""Written intermediate tables, and components of a graph of links."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.functions.lineage import checkpoint_folder


def saved(df: DataFrame, *folders: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back; the values of ``folders`` get a folder each.

    Cuts the lineage: a lost executor costs a read of the table. The folder is the
    checkpoint folder of the session, so all executors see it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"
    (df.write.partitionBy(*folders) if folders else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(taken: list[str], *names: str) -> list[str]:
    """``names``, with underscores before those that are taken."""
    held = {c.lower() for c in taken}
    return [next("_" * k + name for k in range(len(held) + 1) if ("_" * k + name).lower() not in held) for name in names]


def join_classes(rows: DataFrame, classes: DataFrame, key: str, size: str, share: int = 1000) -> DataFrame:
    """``rows`` with the columns of their class; ``classes`` is a written table with one row per ``key`` and its number of rows, ``size``.

    Classes with more than a ``share``-th of all rows are fewer than ``share``, so these are
    broadcast; the others meet their rows by a shuffle in which no key has more rows than that.
    """
    total = classes.agg(F.sum(size)).first()[0] or 0
    large = F.broadcast(classes.filter(F.col(size) * share > total))
    small = classes.filter(F.col(size) * share <= total)
    rest = rows.join(large.select(key), key, "left_anti")
    return rows.join(large, key).unionByName(rest.join(small, key))


def state_of(edges: DataFrame) -> Row:
    return edges.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"),
                     F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (u, v) of longs; the component is its smallest node.

    Alternates the large-star and small-star steps until the edges stay the same, which
    takes a number of rounds logarithmic in the length of the longest chain. Every round is
    an aggregation with map-side combine and a join that adaptive execution can split, and
    is written to the shared folder. Nodes without edges do not appear.
    """
    edges = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    before = state_of(edges)
    while before["n"]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = saved(small.filter("u > v").distinct())
        after = state_of(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
