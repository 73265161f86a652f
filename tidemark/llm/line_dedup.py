"""Removes repeated runs of lines across documents, by overlapping windows of three lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import free_names

WINDOW = 3


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text, any others) with later copies of windows taken out, and n_lines, n_removed.

    Lines are split at ``\\n``. Every run of ``window`` lines is hashed; of equal runs the first one, by doc_id, then
    position, stays and the others are covered. Lines under any covered run go, the rest is joined again, so
    overlapping covered runs merge. Texts of fewer lines have no window and stay; so do null
    texts (0 lines). A text whose lines all go becomes ''. Rows without doc_id come after all others. Equal rows count as one
    document and keep equal texts. Blank lines are lines like others. No rows give no rows. All columns stay; where ``docs`` has an
    n_lines or n_removed of its own, the new one gets underscores in front.
    Repeated windows are found with map-side combine; a window of many copies is only ever a skewed join key.
    """
    names = docs.columns
    n_lines, n_removed = free_names(names, "n_lines", "n_removed")
    # the caller's columns travel as one, so that none can clash with those added here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("all"))
    rows = rows.select("all", F.col("all.doc_id").alias("doc_id"), F.col("all.text").alias("text"), F.xxhash64("all.doc_id", "all.text").alias("row"))
    lines = F.split("text", "\n")
    starts = F.transform(F.sequence(F.lit(0), F.size("l") - window),
                         lambda i: F.struct(F.unhex(F.md5(F.array_join(F.slice("l", i + 1, window), "\n"))).alias("window"), i.alias("at")))
    runs = (rows.filter("text is not null").select("doc_id", "row", lines.alias("l")).filter(F.size("l") >= window)
            .select("doc_id", "row", F.explode(starts).alias("s")).select("s.window", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "s.at").alias("place")))
    repeated = runs.groupBy("window").agg(F.count("*").alias("n"), F.min("place").alias("first")).filter("n > 1").select("window", "first")
    late = (runs.join(repeated, "window").filter(~F.col("place").eqNullSafe(F.col("first")))
            .groupBy("place.doc_id", "place.row").agg(F.collect_set("place.at").alias("late")))
    late = late.select(F.col("doc_id").alias("doc"), F.col("row").alias("other"), "late")
    found = rows.join(late, (F.col("row") == F.col("other")) & F.col("doc_id").eqNullSafe(F.col("doc")), "left")
    covered = F.array_distinct(F.flatten(F.transform("late", lambda s: F.sequence(s, s + window - 1))))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    left = F.array_except(F.sequence(F.lit(0), n - 1), covered)
    found = found.withColumn("n", n).withColumn("left", F.when(F.col("late").isNotNull(), left))
    # the array binds the lines once for all positions
    text = F.transform(F.array(lines), lambda ls: F.array_join(F.transform("left", lambda i: F.get(ls, i)), "\n"))[0]
    text = F.when(F.col("late").isNull(), F.col("text")).otherwise(text)
    gone = F.when(F.col("late").isNull(), 0).otherwise(F.col("n") - F.size("left"))
    return found.select(*[text.alias(c) if c == "text" else F.col("all").getField(c).alias(c) for c in names], F.col("n").alias(n_lines), gone.alias(n_removed))
