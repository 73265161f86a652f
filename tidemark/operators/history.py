"""The point-in-time join under every feature operator.

The log is shuffled once, by user. All anchors, windows and labels are then
computed inside that partitioning: the anchor table is broadcast, and grouping by
(user, anchor) needs no second exchange. The user index travels through the
same shuffle as rows without a date, so every user keeps a row at every anchor
and no index join is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["anchor_date", "user_id"]
NEVER = -(1 << 30)  # below any age


def history(log: DataFrame, anchors: DataFrame, users: DataFrame | None = None, back: int | None = None,
            ahead: int = 0, columns: list[str] | None = None) -> DataFrame:
    """Rows (anchor_date, user_id, age, event_date, ...) with ``-ahead <= age < back``.

    ``age`` is days before the anchor, 0 on the anchor day and negative in the
    target window. Each (anchor, user) of the index has one extra row with a null
    age; conditions on ``age`` skip it by themselves. Users outside the index are left out.
    """
    columns = [c for c in log.columns if c not in ("user_id", "event_date")] if columns is None else columns
    dates = anchors.select("anchor_date")
    index = log if users is None else users
    age = F.date_diff("anchor_date", "event_date")
    if back is not None:
        joined = with_index(log, index, columns, days_from(dates, 1 - back, ahead), users is not None)
    else:
        rows = in_reach(log.select("user_id", "event_date", *columns), dates, None, ahead)
        both = indexed(rows, index, users is not None)
        joined = both.join(F.broadcast(dates), F.col("_index") | (age >= -ahead))
    return joined.withColumn("age", age)


def days_from(anchors: DataFrame, first: int, last: int, origin: str = "anchor_date") -> DataFrame:
    """(anchor_date, _day) for the days ``first`` to ``last`` after ``origin`` of every anchor, and one null day per anchor for the index rows.

    An equality join on the day replaces a comparison of each row with each anchor; the table
    has ``last - first + 2`` rows per anchor whatever the size of the log.
    """
    return anchors.select("anchor_date", F.explode(
        F.array_append(F.sequence(F.date_add(origin, first), F.date_add(origin, last)), F.lit(None).cast("date"))).alias("_day"))


def with_index(log: DataFrame, index: DataFrame, columns: list[str], days: DataFrame, only_index: bool = False) -> DataFrame:
    """Log rows beside every anchor that sees their day, and index rows beside all anchors, shuffled by user.

    ``days`` is a table of :func:`days_from`. Its first and last day are scalar subqueries, which the scan takes as filters.
    """
    day = F.col("event_date")
    rows = log.select("user_id", "event_date", *columns).where(
        (day >= days.select(F.min("_day")).scalar()) & (day <= days.select(F.max("_day")).scalar()))
    return indexed(rows, index, only_index).join(F.broadcast(days), day.eqNullSafe(F.col("_day"))).drop("_day")


def indexed(rows: DataFrame, index: DataFrame, only_index: bool = False) -> DataFrame:
    """``rows`` and one row ``_index`` without a date for every user of the index, in one shuffle by user."""
    index = index.select("user_id").distinct()
    if only_index:
        rows = rows.join(index, "user_id", "left_semi")
    # hides that both sides are hashed by user: the planner would leave out the shuffle of their union, whose partitions need not meet at run time
    index = index.select(F.array_max(F.array("user_id")).alias("user_id"))
    return by_user(rows.withColumn("_index", F.lit(False)).unionByName(index.withColumn("_index", F.lit(True)), allowMissingColumns=True))


def by_user(rows: DataFrame) -> DataFrame:
    """One shuffle by user into the configured number of partitions.

    The number is explicit so that adaptive execution does not merge partitions by
    their size here: rows multiply by the anchors and widen after this point.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "user_id")


def in_reach(rows: DataFrame, anchors: DataFrame, back: int | None, ahead: int) -> DataFrame:
    """Drop the log rows no anchor can see; the bounds are scalar subqueries, which the scan takes as filters."""
    seen = F.col("event_date") <= anchors.select(F.date_add(F.max("anchor_date"), ahead)).scalar()
    if back is not None:
        seen = seen & (F.col("event_date") > anchors.select(F.date_sub(F.min("anchor_date"), back)).scalar())
    return rows.where(seen)


def aggregate(hist: DataFrame, exprs: list[Column], anchors: DataFrame | None = None, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per (anchor, user) of the index.

    Only users with rows in the window go through the aggregates, which may be
    hundreds of columns wide. All the others have the same values, those of the
    aggregates over nothing (null unless an expression says otherwise); a narrow
    count finds them. ``finish`` maps a table of these rows to the result, row by row and without regard to
    the user. With it and ``anchors``, idle users get one finished row per anchor instead of one each.
    """
    # a condition that always holds and needs every column after the join: both branches then read one shuffle of one scan
    hist = hist.where(F.hash(*hist.columns) % 2 < 2)
    # null ages are dropped in a form that cannot move below the shuffle, where it would take the index rows from one branch only
    busy = hist.where(F.coalesce("age", F.lit(NEVER)) > NEVER).groupBy(*KEYS).agg(*exprs)
    idle = hist.groupBy(*KEYS).agg(F.count("age").alias("_n")).where(F.col("_n") == 0).select(*KEYS)
    nothing = hist.where(F.lit(False)).agg(*exprs)
    if finish is None:
        return busy.unionByName(idle.crossJoin(F.broadcast(nothing)))
    nobody = F.lit(None).cast(hist.schema["user_id"].dataType).alias("user_id")
    blank = finish(anchors.select("anchor_date", nobody).distinct().crossJoin(F.broadcast(nothing))).drop("user_id").withColumnRenamed("anchor_date", "_anchor")
    alike = idle.join(F.broadcast(blank), F.col("anchor_date").eqNullSafe(F.col("_anchor"))).drop("_anchor")
    return finish(busy).unionByName(alike)


def within(n: int, skip: int = 0) -> Column:
    """The closed window of ``n`` days that ends ``skip`` days before the anchor."""
    return (F.col("age") >= skip) & (F.col("age") <= skip + n - 1)


def past() -> Column:
    return F.col("age") >= 0


def target_window(horizon: int) -> Column:
    return (F.col("age") < 0) & (F.col("age") >= -horizon)


def fill(df: DataFrame, recency: float = 999.0, recency_names=(), other: float = 0.0) -> DataFrame:
    """Replace nulls: recency columns by a sentinel, every other non-key column by ``other``."""
    def one(c: str) -> str:
        if c in KEYS:
            return c
        is_recency = c.startswith("days_since_") or c in recency_names
        return f"coalesce(cast({c} as double), {float(recency if is_recency else other)}D) AS {c}"

    return df.selectExpr(*[one(c) for c in df.columns])
