"""Anchor dates, legal time splits and calendar columns.

An anchor table has one row per anchor date, so it is never larger than the
calendar (a few hundred rows) and is always the broadcast side of a join.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import count_where, flag
from tidemark.functions.ranking import with_quantiles

# Month and day of the calendar events.
TARGET_HOLIDAYS = {"new_year": (1, 1), "feb23": (2, 23), "mar8": (3, 8), "black_friday": (11, 11)}
DISTANCE_HOLIDAYS = {"new_year": (1, 1), "feb23": (2, 23), "mar8": (3, 8)}
PUBLIC_HOLIDAYS = [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (1, 7), (1, 8), (2, 14), (2, 23),
                   (3, 8), (5, 1), (5, 9), (6, 12), (11, 4), (12, 31)]


def days(n) -> Column:
    return F.make_interval(days=F.lit(n) if isinstance(n, int) else n)


def anchor_table(spark: SparkSession, dates) -> DataFrame:
    """Anchors given by hand, as ISO text or dates; repeated dates count once."""
    return spark.createDataFrame([(d,) for d in sorted({str(d) for d in dates})], "d string").select(
        F.col("d").cast("date").alias("anchor_date")
    )


def _bounds(log: DataFrame) -> DataFrame:
    return log.agg(F.min("event_date").alias("_first"), F.max("event_date").alias("_last"))


def _enough(first: Column, last: Column, value: Column) -> Column:
    """``value`` when ``first <= last``; otherwise the job fails."""
    return F.when(first <= last, value).otherwise(
        F.raise_error(F.lit("not enough days between the first and the last event for one anchor"))
    )


def cv_anchors(log: DataFrame, horizon: int = 30, stride: int = 14, min_history: int = 90,
               n_folds: int | None = 4) -> DataFrame:
    """Back from ``last day - horizon`` in equal steps; the latest ``n_folds`` of them."""
    if n_folds is not None and n_folds <= 0:
        raise ValueError("n_folds must be positive")
    latest = F.date_sub("_last", horizon)
    earliest = F.date_add("_first", min_history - 1)
    steps = F.sequence(latest, earliest, days(-stride))
    if n_folds is not None:
        steps = F.slice(steps, 1, n_folds)
    return _bounds(log).select(F.explode(_enough(earliest, latest, steps)).alias("anchor_date"))


def panel_anchors(log: DataFrame, horizon: int = 30, stride: int = 14, history: int = 90) -> DataFrame:
    """Forward grid from the first day with full history, plus the last legal anchor."""
    return calendar_anchors(log, horizon, stride, history - 1, ())


def calendar_anchors(log: DataFrame, horizon: int = 30, stride: int = 14, first_offset: int = 30,
                     extra=(), newest: int | None = None) -> DataFrame:
    """Forward grid from ``first day + first_offset``, the last legal anchor and ``extra`` dates."""
    start, latest = F.date_add("_first", first_offset), F.date_sub("_last", horizon)
    wanted = F.array(latest, *[F.lit(str(d)).cast("date") for d in extra])
    legal = F.filter(wanted, lambda d: d <= latest)
    dates = F.array_sort(F.array_union(F.sequence(start, latest, days(stride)), legal))
    if newest is not None:
        dates = F.slice(dates, F.greatest(F.size(dates) - newest + 1, F.lit(1)), newest)
    return _bounds(log).select(F.explode(_enough(start, latest, dates)).alias("anchor_date"))


def purged_train_anchors(anchors: DataFrame, horizon: int = 30, newest: int | None = None) -> DataFrame:
    """Pairs (valid_anchor, train_anchor) whose train target ends no later than the valid anchor."""
    valid = anchors.select(F.col("anchor_date").alias("valid_anchor"))
    train = anchors.select(F.col("anchor_date").alias("train_anchor"))
    pairs = valid.join(F.broadcast(train), F.date_add("train_anchor", horizon) <= F.col("valid_anchor"))
    if newest is not None:
        order = Window.partitionBy("valid_anchor").orderBy(F.desc("train_anchor"))
        pairs = pairs.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= newest).drop("_r")
    return pairs


def expanding_folds(outer: DataFrame, anchors: DataFrame, horizon: int = 30, min_train: int = 5) -> DataFrame:
    """Outer anchor, its legal train anchors, the latest of them for inner validation
    and the train anchors legal for that one. The first outer anchor is always kept."""
    train = anchors.select(F.col("anchor_date").alias("_t"))
    legal = outer.select(F.col("anchor_date").alias("outer_anchor")).join(
        F.broadcast(train), F.date_add("_t", horizon) <= F.col("outer_anchor"), "left"
    )
    folds = legal.groupBy("outer_anchor").agg(F.array_sort(F.collect_list("_t")).alias("train_anchors"))
    n = F.size("train_anchors")
    inner_valid = F.coalesce(F.array_max("train_anchors"), F.col("outer_anchor"))
    number = Window.orderBy("outer_anchor")  # at most one row per calendar day
    folds = folds.select(
        F.concat(F.lit("fold_"), F.lpad((F.row_number().over(number) - 1).cast("string"), 2, "0")).alias("fold_id"),
        "outer_anchor", "train_anchors", inner_valid.alias("inner_valid_anchor"), n.alias("n_train_anchors"),
    ).withColumn(
        "inner_train_anchors",
        F.filter("train_anchors", lambda t: F.date_add(t, horizon) <= F.col("inner_valid_anchor")),
    )
    return folds.where((F.col("n_train_anchors") >= min_train) | (F.col("fold_id") == "fold_00"))


def paired_folds(inference_anchors: DataFrame, horizon: int = 30) -> DataFrame:
    """Train snapshot one horizon earlier, both target windows, per inference anchor."""
    a = F.col("anchor_date")
    return inference_anchors.select(
        F.date_sub(a, horizon).alias("train_anchor"),
        F.date_sub(a, horizon - 1).alias("train_target_start"),
        a.alias("train_target_end"),
        a.alias("inference_anchor"),
        F.date_add(a, 1).alias("validation_target_start"),
        F.date_add(a, horizon).alias("validation_target_end"),
    )


def split_windows(anchors: DataFrame, horizon: int = 30, state: int = 90, short: int = 180, long: int = 365) -> DataFrame:
    """State, sequence and target bounds of each anchor."""
    a = F.col("anchor_date")
    return anchors.withColumns({
        "state_history_start": F.date_sub(a, state - 1),
        "state_history_end": a,
        "model_target_start": F.date_add(a, 1),
        "model_target_end": F.date_add(a, horizon),
        "short_history_start": F.date_sub(a, short - 1),
        "long_history_start": F.date_sub(a, long - 1),
    })


def two_run_pairs(anchors: DataFrame, horizon: int = 30) -> DataFrame:
    """All legal (meta anchor M, validation anchor V): M's target ends by V."""
    return purged_train_anchors(anchors, horizon).select(
        F.col("train_anchor").alias("meta_anchor"), F.col("valid_anchor").alias("validation_anchor")
    )


def two_run_profile(anchors: DataFrame, meta: Column, validation: Column, horizon: int = 30) -> DataFrame:
    """Manifest of the two runs: run A trains up to M, run B up to V, one holdout each."""
    ends = F.date_add("anchor_date", horizon)
    runs = F.array(F.struct(F.lit("RUN_A").alias("run"), meta.alias("holdout")),
                   F.struct(F.lit("RUN_B").alias("run"), validation.alias("holdout")))
    rows = anchors.select("anchor_date", F.explode(runs).alias("_r")).select("anchor_date", "_r.run", "_r.holdout")
    train = rows.where(ends <= F.col("holdout")).withColumn("role", F.lit("train"))
    held = rows.where(F.col("anchor_date") == F.col("holdout")).withColumn("role", F.lit("holdout"))
    return split_windows(train.unionByName(held).select("run", "role", "anchor_date"), horizon)


def check_fold_safety(pairs: DataFrame, horizon: int = 30) -> DataFrame:
    """Rows of (valid_anchor, train_anchor) whose train target reaches past the valid anchor."""
    return pairs.withColumn("train_target_end", F.date_add("train_anchor", horizon)).where(
        F.col("train_target_end") > F.col("valid_anchor")
    ).withColumn("days_over", F.date_diff("train_target_end", "valid_anchor"))


def overlap_days(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.date_diff(F.least(a_end, b_end), F.greatest(a_start, b_start)) + 1, F.lit(0))


def anchor_edge_audit(labels: DataFrame, valid_anchor: Column, horizon: int = 30, history: int = 365,
                      target: str = "target") -> DataFrame:
    """Bounds, zero rate, mean and quantiles of the target of each anchor, and the
    overlap of its target window with the one of ``valid_anchor``."""
    y = F.col(target)
    summary = labels.groupBy("anchor_date").agg(
        F.count(F.lit(1)).alias("n_users"),
        F.avg(flag(y == 0, "double")).alias("target_zero_rate"),
        F.avg(y).alias("mean_target"),
    )
    summary = with_quantiles(summary, labels, ["anchor_date"], target,
                             {"p50_target": .5, "p90_target": .9, "p99_target": .99})
    a = F.col("anchor_date")
    return summary.withColumns({
        "input_start": F.date_sub(a, history - 1), "input_end": a,
        "target_start": F.date_add(a, 1), "target_end": F.date_add(a, horizon),
        "overlap_days_with_valid": F.when(a == valid_anchor, 0).otherwise(overlap_days(
            F.date_add(a, 1), F.date_add(a, horizon), F.date_add(valid_anchor, 1), F.date_add(valid_anchor, horizon))),
    })


def anchor_weights(df: DataFrame, late_from: str, newest_from: str, base: float = 1.0, late: float = 1.5,
                   newest: float = 2.5) -> DataFrame:
    """Sample weight by how recent the anchor is."""
    a = F.col("anchor_date")
    return df.withColumn(
        "weight",
        F.when(a >= F.lit(newest_from).cast("date"), newest).when(a >= F.lit(late_from).cast("date"), late).otherwise(base),
    )


def load_purged_panel(panel: DataFrame, anchors: DataFrame, valid_anchor: str, horizon: int = 30) -> DataFrame:
    """Rows of all legal train anchors (role train) and of the validation anchor (role valid)."""
    v = F.lit(valid_anchor).cast("date")
    wanted = anchors.where((F.date_add("anchor_date", horizon) <= v) | (F.col("anchor_date") == v))
    return panel.join(F.broadcast(wanted), "anchor_date", "left_semi").withColumn(
        "role", F.when(F.col("anchor_date") == v, "valid").otherwise("train")
    )


# --- calendar -------------------------------------------------------------------------------

def _next(a: Column, month: int, day: int) -> Column:
    """The next such calendar day on or after ``a``."""
    this_year = F.make_date(F.year(a), F.lit(month), F.lit(day))
    return F.when(this_year >= a, this_year).otherwise(F.make_date(F.year(a) + 1, F.lit(month), F.lit(day)))


def _occurs(a: Column, month: int, day: int, horizon: int) -> Column:
    return _next(F.date_add(a, 1), month, day) <= F.date_add(a, horizon)


def holiday_distance(anchors: DataFrame, horizon: int = 30) -> DataFrame:
    """Days to the next holidays and whether the target window covers one."""
    a = F.col("anchor_date")
    covered = flag(F.lit(False), "double")
    for m, d in TARGET_HOLIDAYS.values():
        covered = F.greatest(covered, flag(_occurs(a, m, d, horizon), "double"))
    out = {f"days_to_{name}": F.date_diff(_next(a, m, d), a).cast("double") for name, (m, d) in DISTANCE_HOLIDAYS.items()}
    return anchors.withColumns({**out, "target_window_covers_holiday": covered})


def holiday_table(anchors: DataFrame, month_days=None) -> DataFrame:
    """Holiday dates of the years the anchors touch (a few dozen rows)."""
    month_days = month_days or list(TARGET_HOLIDAYS.values())
    years = anchors.agg(F.min(F.year("anchor_date")).alias("lo"), F.max(F.year("anchor_date")).alias("hi"))
    md = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d")) for m, d in month_days])
    return years.select(F.explode(F.sequence("lo", F.col("hi") + 1)).alias("y"), md.alias("md")).select(
        "y", F.explode("md").alias("md")
    ).select(F.make_date("y", "md.m", "md.d").alias("holiday"))


def target_calendar(anchors: DataFrame, holidays: DataFrame, horizon: int = 30) -> DataFrame:
    """Calendar position of anchor and target window, and the holidays inside it."""
    a = F.col("anchor_date")
    ahead = F.date_diff("holiday", a)
    inside = (ahead >= 1) & (ahead <= horizon)
    day_is = lambda m, d: (F.month("holiday") == m) & (F.dayofmonth("holiday") == d)
    hits = anchors.join(F.broadcast(holidays), ahead >= 0, "left").groupBy("anchor_date").agg(
        *[F.max(flag(inside & day_is(m, d), "double")).alias(f"target_contains_{name}")
          for name, (m, d) in TARGET_HOLIDAYS.items()],
        F.max(flag(inside, "double")).alias("target_contains_any_holiday"),
        count_where(inside).cast("double").alias("number_of_holidays_in_target"),
        F.coalesce(F.min(ahead), F.lit(999)).cast("double").alias("days_to_nearest_holiday"),
    )
    doy = lambda d: F.dayofyear(d).cast("double")
    mid = doy(F.date_add(a, horizon // 2))
    turn = mid * F.lit(2.0) * F.pi() / F.lit(365.25)
    return hits.withColumns({
        "anchor_month": F.month(a).cast("double"),
        "anchor_day_of_week": F.weekday(a).cast("double"),
        "anchor_day_of_year": doy(a),
        "target_start_doy": doy(F.date_add(a, 1)),
        "target_midpoint_doy": mid,
        "target_end_doy": doy(F.date_add(a, horizon)),
        "sin_doy": F.sin(turn),
        "cos_doy": F.cos(turn),
    })


def calendar_context(anchors: DataFrame, month_days=None, horizon: int = 30) -> DataFrame:
    """Weekends and public holidays among the target days, nearest holiday within a year."""
    month_days = month_days or PUBLIC_HOLIDAYS
    a = F.col("anchor_date")
    target_days = anchors.select(
        "anchor_date", F.explode(F.sequence(F.date_add(a, 1), F.date_add(a, horizon))).alias("_d")
    )
    listed = F.array(*[F.lit(m * 100 + d) for m, d in month_days])
    counted = target_days.groupBy("anchor_date").agg(
        count_where(F.weekday("_d") >= 5).cast("double").alias("cal_weekends_in_target_window"),
        count_where(F.array_contains(listed, F.month("_d") * 100 + F.dayofmonth("_d"))).cast("double")
        .alias("cal_holiday_days_in_target_window"),
    )
    nearest = F.least(F.lit(365), *[F.date_diff(_next(a, m, d), a) for m, d in month_days])
    turn = F.dayofyear(a).cast("double") * F.lit(2.0) * F.pi() / F.lit(365.25)
    return counted.withColumns({
        "cal_anchor_month": F.month(a).cast("double"),
        "cal_anchor_doy_sin": F.sin(turn),
        "cal_anchor_doy_cos": F.cos(turn),
        "cal_days_to_nearest_holiday": nearest.cast("double"),
    })


def technical_columns(df: DataFrame, history: int = 90, horizon: int = 30, data_start: str | date | None = None) -> DataFrame:
    """History and target bounds; available history is cut by the first log day."""
    a = F.col("anchor_date")
    available = F.lit(history)
    if data_start is not None:
        available = F.least(available, F.date_diff(a, F.lit(str(data_start)).cast("date")) + 1)
    return df.withColumns({
        "history_start": F.date_sub(a, history - 1), "history_end": a,
        "target_start": F.date_add(a, 1), "target_end": F.date_add(a, horizon),
        "available_history_days": available,
    })
