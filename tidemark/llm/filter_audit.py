"""How filters of documents interact: what each one removes after any prefix of the others, in every order.

1. One pass over the texts marks what each filter fails; identical texts are found by SHA-256 of the whole text.
   Every filter's failing rows are written as an id table of their own (a folder per filter).
2. Filter by filter, a left-semi and a left-anti join with its id table split the rows that the prefix has left
   (and, for the other orders, those that it has removed), so after the last one the rows lie in cells: one
   per set of filters that they fail. Rows are counted per part and cell, all of them and those in the id tables of good
   and of toxic documents (left-semi joins again).
3. The survivors of any prefix are whole cells: a left-anti join of the cells with the cells that fail one of the prefix's filters.
   A left-semi join with the cells that the next filter fails gives what it removes; what its failing cells have besides is redundant.
   Both joins run for all prefixes at once, over at most 32 cells per part.

So ten joins over narrow ids serve all 120 orders, and their number does not depend on the orders.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import join_classes, saved

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = r"[ \t-\r]+"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that see one text only."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    n_capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {"A": n_words < 200, "B": 100 * n_distinct < 50 * n_words, "C": 100 * n_capitals > 3 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def failing(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (_row, doc_id, part), and the failing-id relations (filter, _row) as one written table with a folder per filter."""
    text = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    marks = text_failures(F.col("_text"))
    rows = saved(text.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "part", F.unhex(F.sha2("_text", 256)).alias("_h"),
                             F.concat_ws("", *[F.when(c, f) for f, c in marks.items()]).alias("_marks")))
    first = saved(rows.groupBy("_h").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")))
    late = join_classes(rows.select("_h", "_row", "doc_id"), first, "_h", "_n").filter("doc_id > _first")
    fails = rows.select(F.explode(F.split(F.col("_marks"), "")).alias("filter"), "_row").filter("filter <> ''")
    fails = fails.unionByName(late.select(F.lit("E").alias("filter"), "_row"))
    return rows.select("_row", "doc_id", "part"), saved(fails, "filter")


def cells(rows: DataFrame, fails: DataFrame, filters: str) -> DataFrame:
    """``rows`` with ``cell``: bit i is set where the row fails filter i. A left-semi and a left-anti join per filter."""
    split = rows.withColumn("cell", F.lit(0))
    for i, f in enumerate(filters):
        ids = fails.filter(F.col("filter") == f).select("_row")
        hit = split.join(ids, "_row", "left_semi").withColumn("cell", F.col("cell") + F.lit(1 << i))
        split = hit.unionByName(split.join(ids, "_row", "left_anti"))
        if i % 2:  # each branch reads its parent twice
            split = saved(split)
    return split


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """The id table of documents that carry the label; an id with contrary labels carries it."""
    return labels.filter((F.col(column) == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def constant(spark: SparkSession, rows: Iterable[tuple], names: str) -> DataFrame:
    """A table of constants of the plan, its size fixed by the number of filters."""
    values = ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names.split())})")


def prefix_effects(counts: DataFrame, filters: str) -> DataFrame:
    """(part, prefix, filter, removed, redundant, unique_fails, good_lost, toxic_lost, left) for every part, set of filters and next filter.

    ``prefix`` is a set as bits, ``left`` the rows that it leaves to the filter.
    """
    spark, n = counts.sparkSession, len(filters)
    sets = range(1 << n)
    fails = constant(spark, [(c, i) for c in sets for i in range(n) if c >> i & 1], "cell filter")
    members = constant(spark, [(s, i) for s in sets for i in range(n) if s >> i & 1], "prefix filter")
    steps = constant(spark, [(s, i) for s in sets for i in range(n) if not s >> i & 1], "prefix filter")
    dead = F.broadcast(members.join(F.broadcast(fails), "filter").select("prefix", "cell").distinct())  # at most 32 x 32 rows
    candidates = counts.join(F.broadcast(constant(spark, [(s, c) for s in sets for c in sets], "prefix cell")), "cell")
    alive = candidates.join(dead, ["prefix", "cell"], "left_anti")
    left = alive.groupBy("part", "prefix").agg(F.sum("n").alias("left"))
    at_step = lambda df: df.join(F.broadcast(steps), "prefix")
    removed = at_step(alive).join(F.broadcast(fails), ["filter", "cell"], "left_semi").groupBy("part", "prefix", "filter").agg(
        F.sum("n").alias("removed"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost"))
    redundant = at_step(candidates.join(dead, ["prefix", "cell"], "left_semi")).join(F.broadcast(fails), ["filter", "cell"], "left_semi").groupBy(
        "part", "prefix", "filter").agg(F.sum("n").alias("redundant"))
    alone = counts.join(F.broadcast(constant(spark, [(1 << i, i) for i in range(n)], "cell filter")), "cell").groupBy("part", "filter").agg(F.sum("n").alias("unique_fails"))
    out = at_step(counts.select("part").distinct().withColumn("prefix", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1)))))
    for more, keys in ((left, ["part", "prefix"]), (removed, ["part", "prefix", "filter"]), (redundant, ["part", "prefix", "filter"]), (alone, ["part", "filter"])):
        out = out.join(more, keys, "left")
    return out.fillna(0, ["left", "removed", "good_lost", "toxic_lost", "redundant", "unique_fails"])


def filter_interactions(docs: DataFrame, labels: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), a row per part, order and step.

    ``docs`` has doc_id, text and lang, ``labels`` doc_id, quality and toxic; other columns are ignored. Every row counts as a document,
    also rows that repeat a doc_id or have none. Null texts are empty (they fail A, and E where a smaller doc_id has an empty text), a null lang is the part ''.
    A row without doc_id never fails E, as no doc_id is smaller, and has no labels; of rows that repeat a text, all with the smallest doc_id
    pass E. Rows of a doc_id that ``labels`` has several times lose a label if any of its rows carries it. Empty ``docs`` give no rows, empty ``labels`` zeros.
    """
    rows, fails = failing(docs)
    cell = saved(cells(rows, fails, filters))
    counted = lambda df, name: df.groupBy("part", "cell").agg(F.count("*").alias(name))
    counts = counted(cell, "n")
    for name, column in (("good", "quality"), ("toxic", "toxic")):
        counts = counts.join(counted(cell.join(labelled(labels, column), "doc_id", "left_semi"), name), ["part", "cell"], "left")
    effects = saved(prefix_effects(saved(counts.fillna(0)), filters))
    n = len(filters)
    orders = [(tuple(p), "".join(filters[i] for i in p)) for p in permutations(range(n))]
    steps = constant(docs.sparkSession, [(name, k + 1, sum(1 << i for i in p[:k]), p[k]) for p, name in orders for k in range(n)], "filter_order step prefix filter")
    every = effects.join(F.broadcast(steps), ["prefix", "filter"])
    shapley = every.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return every.join(shapley, ["part", "filter"]).select("part", "filter_order", "step", (F.col("left") - F.col("removed")).alias("kept"), "removed", "redundant", "unique_fails",
                                                        "good_lost", "toxic_lost", "shapley")
