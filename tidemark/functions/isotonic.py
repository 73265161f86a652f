"""Isotonic regression by pooling adjacent violators inside ranges and across their borders.

Pooling any two adjacent blocks that violate the order is a step towards the one solution, in whatever
sequence the steps are taken. So ranges of values are pooled side by side, each by one task; then the ranges are cut anew,
never at a border whose two blocks still violate the order, until no border does. The driver sees a
row per range, that is one for every ``RANGE`` blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import cut_lineage

RANGE = 50_000  # distinct values that one task pools, about
BLOCK = "lo double, hi double, y double, w double"


def pooled(lo: np.ndarray, hi: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of rising ``y`` from blocks in order of their values."""
    out: list[list[float]] = []
    for block in zip(lo.tolist(), hi.tolist(), (y * w).tolist(), w.tolist()):
        low, high, total, weight = block
        while out and out[-1][2] * weight >= total * out[-1][3]:
            low, _, before, more = out.pop()
            total, weight = total + before, weight + more
        out.append([low, high, total, weight])
    low, high, total, weight = np.array(out).T
    return low, high, total / weight, weight


def cut_points(df: DataFrame, value: str, ranges: int, shift: float = 0.0) -> list[float]:
    """At most ``ranges`` values that cut the rows into ranges of about equal size."""
    shares = [(i + shift) / ranges for i in range(0 if shift else 1, ranges)]
    if not shares:
        return []
    found = df.agg(F.percentile_approx(value, F.array(*map(F.lit, shares)), 100 * ranges).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def in_ranges(df: DataFrame, value: str, cuts: list[float]) -> DataFrame:
    """``df`` with ``_range``, the number of cut points that are not above the value."""
    if not cuts:
        return df.withColumn("_range", F.lit(0))
    found = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=value, outputCol="_range").transform(df)
    return found.withColumn("_range", F.col("_range").cast("int"))


def _pool_range(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("lo")
    lo, hi, y, w = pooled(*(rows[c].to_numpy() for c in ("lo", "hi", "y", "w")))
    return pd.DataFrame({"lo": lo, "hi": hi, "y": y, "w": w, "_range": rows["_range"].iloc[0]})


def isotonic_blocks(points: DataFrame, per_range: int = RANGE) -> DataFrame:
    """Blocks (lo, hi, y, w) of the rising weighted least-squares fit to ``points`` (value, y, w), one row per distinct value."""
    blocks, shift, torn = points.select(F.col("value").alias("lo"), F.col("value").alias("hi"), "y", "w"), 0.0, []
    blocks = cut_lineage(blocks)
    while True:
        ranges = math.ceil(blocks.count() / per_range)
        cuts = cut_points(blocks, "lo", ranges, shift) if ranges > 1 else []
        cuts = [c for c in cuts if not any(a < c <= b for a, b in torn)]
        found = cut_lineage(in_ranges(blocks, "lo", cuts).groupBy("_range").applyInPandas(_pool_range, f"{BLOCK}, _range int"))
        ends = found.groupBy("_range").agg(F.min(F.struct("lo", "y")).alias("first"), F.max(F.struct("lo", "y")).alias("last")).orderBy("_range").collect()
        torn = [(a["last"]["lo"], b["first"]["lo"]) for a, b in zip(ends, ends[1:]) if a["last"]["y"] >= b["first"]["y"]]
        blocks = found.drop("_range")
        if not torn:
            return blocks
        shift = 0.5 - shift


def interpolated(values: DataFrame, blocks: DataFrame, per_range: int = RANGE) -> DataFrame:
    """(value, fitted) for distinct ``values``: linear between the blocks, constant beyond the first and the last one.

    Values and block ends are sorted range by range; what a range lacks on either side comes from one row per range.
    """
    knot = F.struct("value", "y").alias("knot")
    ends = blocks.select(F.col("lo").alias("value"), "y").unionByName(blocks.where("hi > lo").select(F.col("hi").alias("value"), "y")).select("value", knot)
    both = cut_lineage(values.select("value", F.lit(None).cast("struct<value:double,y:double>").alias("knot")).unionByName(ends))
    ranges = math.ceil(both.count() / per_range)
    ranged = in_ranges(both, "value", cut_points(both, "value", ranges) if ranges > 1 else [])
    order = Window.orderBy("_range")  # a row per range
    beside = ranged.groupBy("_range").agg(F.min("knot").alias("first"), F.max("knot").alias("last")).select(
        "_range", F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    inside = Window.partitionBy("_range").orderBy("value", F.col("knot").isNull())
    low = F.last("knot", True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first("knot", True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    near = ranged.select("_range", "value", "knot", low.alias("low"), high.alias("high")).where("knot is null").join(beside, "_range")
    near = near.select("value", F.coalesce("low", "before").alias("low"), F.coalesce("high", "after").alias("high"))
    share = (F.col("value") - F.col("low.value")) / (F.col("high.value") - F.col("low.value"))
    fitted = F.when(F.col("low").isNull(), F.col("high.y")).when(F.col("high").isNull() | (F.col("low.value") == F.col("value")), F.col("low.y")).otherwise(
        F.col("low.y") + (F.col("high.y") - F.col("low.y")) * share)
    return near.select("value", fitted.alias("fitted"))
