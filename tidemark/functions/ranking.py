"""Ordered statistics that never sort a whole data set in one task.

Everything here works on value counts: rows are reduced to
``(keys, value, weights)`` first, so a value shared by a third of all rows is a
single row afterwards. The counts are written once and cut into ranges of bounded size, a window runs inside
each range, and the totals of the lower ranges are added. The ranges only steer the work; the results are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut_lineage, written

RANGE = 50_000  # distinct values that one task ranks, about


def running_totals(counts: DataFrame, keys: list[str], value: str, sums: list[str], per_range: int = RANGE) -> DataFrame:
    """Add ``<s>_below`` (sum over smaller values) and ``<s>_all`` for each of ``sums``.

    ``counts`` holds one row per ``(keys, value)``. The number of ranges follows the number of rows, one for ``per_range`` of them;
    Spark's range shuffle finds their borders over keys and value together. Ranges and their totals are
    one row per range and key group, and reach no single task that grows with the data beyond that.
    """
    keys = list(keys)
    counts = cut_lineage(counts)
    ranges = math.ceil(counts.count() / per_range)
    if ranges <= 1:
        whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        lower = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select("*", *[F.coalesce(F.sum(s).over(lower), F.lit(0)).alias(f"{s}_below") for s in sums], *[F.sum(s).over(whole).alias(f"{s}_all") for s in sums])
    # written, so that every reader sees the same borders
    ranged = written(counts.repartitionByRange(ranges, *keys, value).withColumn("_range", F.spark_partition_id()))
    group = Window.partitionBy(*[F.col(f"_k{i}") for i in range(len(keys))]) if keys else Window.partitionBy(F.lit(0))
    lower = group.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    names = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    before = ranged.groupBy(*names, F.col("_range").alias("_r")).agg(*[F.sum(s).alias(s) for s in sums]).select(
        *[f"_k{i}" for i in range(len(keys))], "_r", *[F.coalesce(F.sum(s).over(lower), F.lit(0)).alias(f"_before_{s}") for s in sums], *[F.sum(s).over(group).alias(f"{s}_all") for s in sums])
    inside = Window.partitionBy("_range", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_in_{s}") for s in sums])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_range") == F.col("_r")]
    return out.join(before, same).select(
        *counts.columns, *[(F.col(f"_before_{s}") + F.col(f"_in_{s}")).alias(f"{s}_below") for s in sums], *[f"{s}_all" for s in sums])


def value_counts(df: DataFrame, keys: list[str], value: str, **weights: Column) -> DataFrame:
    """One row per ``(keys, value)`` with ``n`` rows and any summed ``weights``."""
    # -0.0 and 0.0 are one value
    rows = df.where(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double") + F.lit(0.0))
    return rows.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(w).alias(name) for name, w in weights.items()]
    )


def quantiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles, one output column per entry of ``points``."""
    ranked = running_totals(value_counts(df, keys, value), keys, value, ["n"])
    upto = F.col("n_below") + F.col("n")
    picks = []
    for name, q in points.items():
        pos = (F.col("n_all") - 1) * F.lit(float(q))
        picks += [
            F.min(F.when(upto > F.floor(pos), F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(upto > F.ceil(pos), F.col(value))).alias(f"_hi_{name}"),
        ]
    got = ranked.groupBy(*keys).agg(F.max("n_all").alias("_n"), *picks)
    outs = []
    for name, q in points.items():
        pos = (F.col("_n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return got.select(*keys, *outs)


def with_quantiles(summary: DataFrame, df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Join quantiles of ``value`` onto an aggregate of the same ``keys``."""
    q = quantiles(df, keys, value, points)
    if not keys:
        return summary.crossJoin(F.broadcast(q))  # one row each
    return summary.join(q, keys, "left")


def average_ranks(counts: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Average rank (ties share it) of every distinct value, from its counts ``n``."""
    return running_totals(counts, keys, value, ["n"]).select(
        *keys, value, (F.col("n_below") + (F.col("n") + 1) / F.lit(2.0)).alias(name))


def spearman(pairs: DataFrame, keys: list[str], x: str, y: str, y_ranks: DataFrame | None = None) -> DataFrame:
    """Rank correlation from counted pairs ``(keys, x, y, n)``.

    Rows with equal pairs are one row here, so a pair shared by most rows costs
    nothing; a value that meets very many partners is split by the skew join of
    adaptive execution. ``y_ranks`` may be given when they are the same in all groups.
    """
    per_value = lambda v: pairs.groupBy(*keys, v).agg(F.sum("n").alias("n"))
    ranked = pairs.join(average_ranks(per_value(x), keys, x, "_rx"), [*keys, x])
    if y_ranks is None:
        ranked = ranked.join(average_ranks(per_value(y), keys, y, "_ry"), [*keys, y])
    else:
        ranked = ranked.join(y_ranks.withColumnRenamed(y_ranks.columns[-1], "_ry"), y)
    n = F.col("n").cast("double")
    mean = lambda e: F.sum(e * n) / F.sum(n)
    m = ranked.groupBy(*keys).agg(
        mean(F.col("_rx")).alias("mx"), mean(F.col("_ry")).alias("my"), mean(F.col("_rx") * F.col("_rx")).alias("xx"),
        mean(F.col("_ry") * F.col("_ry")).alias("yy"), mean(F.col("_rx") * F.col("_ry")).alias("xy"))
    spread = lambda sq, mu: F.col(sq) - F.col(mu) * F.col(mu)
    vx, vy = spread("xx", "mx"), spread("yy", "my")
    return m.select(*keys, F.when((vx > 0) & (vy > 0), (F.col("xy") - F.col("mx") * F.col("my")) / F.sqrt(vx * vy)).alias("spearman"))


def count_pairs(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    plain = lambda c: (F.col(c).cast("double") + F.lit(0.0)).alias(c)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, plain(x), plain(y))
    return rows.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("n"))


def unpivot(df: DataFrame, keep: list[str], features: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Long form (keep..., feature, value) with double values."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(keep, features, name, value)
