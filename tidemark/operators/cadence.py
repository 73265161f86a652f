"""Purchase rhythm, personal propensity, last-year analogues and lifecycle features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import count_where, flag, log_amount, nearest_quantile, ratio, sum_where
from tidemark.operators.anchors import calendar_context
from tidemark.operators.derived import decay_intent, missing_flags
from tidemark.operators.history import KEYS, aggregate, days_from, fill, history, past, with_index, within
from tidemark.operators.labels import transition_state
from tidemark.operators.windows import SHORT_METRICS, positive, purchase, recency_exprs, short_window_exprs

SMOOTHING = {"k5": 5.0, "k20": 20.0}


def with_gaps(hist: DataFrame) -> DataFrame:
    """Days to the previous purchase day and to the previous active day of the user.

    The window runs inside the (user, anchor) frame, at most one row per day.
    """
    older = Window.partitionBy("user_id", "anchor_date").orderBy(F.desc_nulls_first("age"))
    reach = older.rowsBetween(Window.unboundedPreceding, -1)
    buys = past() & positive("gmv")
    return hist.withColumns({
        "_prev_buy_age": F.min(F.when(buys, F.col("age"))).over(reach),
        "_prev_age": F.min("age").over(reach),
    }).withColumns({
        "gap": F.when(buys, F.col("_prev_buy_age") - F.col("age")),
        "act_gap": F.when(past(), F.col("_prev_age") - F.col("age")),
    })


def purchase_gaps(log: DataFrame, anchors: DataFrame, users: DataFrame | None = None, days: int = 180) -> DataFrame:
    """One row per purchase day that has an earlier one in the history."""
    rows = with_gaps(history(log, anchors, users, back=days, columns=["gmv"]))
    return rows.where(F.col("gap").isNotNull()).select(*KEYS, "event_date", "age", "gap")


def gap_exprs() -> list[Column]:
    gaps = F.array_sort(F.collect_list("gap"))  # at most one per day of the history
    by_date = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("gap").isNotNull(), F.struct("age", "gap")))), lambda s: s["gap"]
    )
    return [
        F.count("gap").alias("number_of_observed_gaps"),
        F.get(by_date, F.lit(0)).alias("last_interpurchase_gap"),
        F.get(by_date, F.lit(1)).alias("previous_interpurchase_gap"),
        F.avg("gap").alias("mean_interpurchase_gap"),
        F.median("gap").alias("median_interpurchase_gap"),
        F.stddev_samp("gap").alias("std_interpurchase_gap"),
        F.min("gap").alias("min_interpurchase_gap"),
        F.max("gap").alias("max_interpurchase_gap"),
        nearest_quantile(gaps, 0.25).alias("p25_interpurchase_gap"),
        nearest_quantile(gaps, 0.75).alias("p75_interpurchase_gap"),
    ]


def nth_purchase_exprs() -> list[Column]:
    ages = F.array_sort(F.collect_set(F.when(past() & positive("gmv"), F.col("age"))))
    return [
        F.get(ages, F.lit(1)).alias("days_since_second_last_purchase"),
        F.get(ages, F.lit(2)).alias("days_since_third_last_purchase"),
    ]


def week_exprs() -> list[Column]:
    week = F.floor(F.col("age") / 7)
    return [
        F.max("act_gap").alias("longest_inactivity_streak"),
        count_where(past() & (week < 4)).alias("active_weeks_30d"),
        count_where(past() & (week < 13)).alias("active_weeks_90d"),
        F.size(F.collect_set(F.when(past(), week))).alias("active_weeks_180d"),
        F.max(F.when(past(), F.col("age"))).alias("history_span"),
        count_where(past()).alias("history_days"),
    ]


def gap_stats(log, anchors, users=None, days: int = 180) -> DataFrame:
    return aggregate(with_gaps(history(log, anchors, users, back=days, columns=["gmv"])), gap_exprs())


def nth_last_purchase(log, anchors, users=None, days: int = 180, sentinel: float = 365.0) -> DataFrame:
    return fill(aggregate(history(log, anchors, users, back=days, columns=["gmv"]), nth_purchase_exprs()), sentinel)


def activity_weeks(log, anchors, users=None, days: int = 180) -> DataFrame:
    return aggregate(with_gaps(history(log, anchors, users, back=days, columns=["gmv"])), week_exprs())


def cadence_lists(df: DataFrame) -> DataFrame:
    """Arrays of a row's ``_days`` (ascending, age * 2, one more on a purchase day): ages of purchases, their gaps by date and by size, gaps of activity."""
    steps = lambda c: F.zip_with(F.slice(c, F.lit(2), F.size(c)), F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0))), lambda older, newer: older - newer)
    half = lambda v: F.shiftright(v, 1)
    df = df.withColumns({"_ages": F.transform("_days", half), "_buys": F.transform(F.filter("_days", lambda v: v % 2 == 1), half)})
    return df.withColumns({"_act_gaps": steps("_ages"), "_gaps": steps("_buys")}).withColumn("_sorted", F.sort_array("_gaps"))


def cadence_values(df: DataFrame) -> DataFrame:
    """The columns of :func:`gap_exprs`, :func:`nth_purchase_exprs` and :func:`week_exprs` from the arrays of a row."""
    zero, one, two = F.lit(0), F.lit(1), F.lit(2)
    n = F.size("_gaps")
    total = lambda c, of: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + of(v))
    df = cadence_lists(df).withColumn("_mean", F.when(n > 0, total("_gaps", lambda v: v.cast("double")) / n))
    middle = lambda k: F.get("_sorted", k).cast("double")
    at = lambda c, cond: F.size(F.filter(c, cond)).cast("long")
    return df.select(
        *KEYS,
        F.size("_buys").cast("long").alias("purchase_days_180d"), at("_buys", lambda v: v < 90).alias("_buy_days_90"),
        F.get("_buys", zero).alias("_since_last"), F.get("_buys", F.size("_buys") - 1).alias("days_since_first_purchase"),
        F.get(F.array_distinct("_buys"), one).alias("days_since_second_last_purchase"), F.get(F.array_distinct("_buys"), two).alias("days_since_third_last_purchase"),
        n.cast("long").alias("number_of_observed_gaps"),
        F.get("_gaps", zero).alias("last_interpurchase_gap"), F.get("_gaps", one).alias("previous_interpurchase_gap"),
        F.col("_mean").alias("mean_interpurchase_gap"),
        ((middle(F.floor((n - 1) / 2).cast("int")) + middle(F.floor(n / 2).cast("int"))) / 2).alias("median_interpurchase_gap"),
        F.when(n > 1, F.sqrt(F.aggregate("_gaps", zero.cast("double"), lambda acc, v: acc + (v - F.col("_mean")) * (v - F.col("_mean"))) / (n - 1))).alias("std_interpurchase_gap"),
        F.get("_sorted", zero).alias("min_interpurchase_gap"), F.get("_sorted", n - 1).alias("max_interpurchase_gap"),
        nearest_quantile(F.col("_sorted"), 0.25).alias("p25_interpurchase_gap"), nearest_quantile(F.col("_sorted"), 0.75).alias("p75_interpurchase_gap"),
        F.array_max("_act_gaps").alias("longest_inactivity_streak"),
        at("_ages", lambda v: v < 28).alias("active_weeks_30d"), at("_ages", lambda v: v < 91).alias("active_weeks_90d"),
        F.size(F.array_distinct(F.transform("_ages", lambda v: F.floor(v / 7).cast("int")))).alias("active_weeks_180d"),
        F.get("_ages", F.size("_ages") - 1).alias("history_span"), F.size("_ages").cast("long").alias("history_days"),
    )


def cadence_features(log, anchors, users=None, days: int = 180) -> DataFrame:
    """The 33 purchase-rhythm features on the full index.

    The one list per (user, anchor) has an entry per active day of the bounded history; all else is computed from it,
    without a sort by day and without lists and quantiles of their own for every feature.
    """
    seen = F.when(past(), F.col("age") * 2 + flag(positive("gmv")))
    hist = history(log, anchors, users, back=days, columns=["gmv"])
    return aggregate(hist, [F.sort_array(F.collect_list(seen)).alias("_days")], anchors, lambda raw: cadence_columns(cadence_values(raw)))


def cadence_columns(raw: DataFrame) -> DataFrame:
    n = F.col("purchase_days_180d")
    c = lambda name, value: F.coalesce(F.col(name).cast("double"), F.lit(value))
    enough = n >= 2
    half, year = 180.0, 365.0
    filled = raw.select(
        *KEYS, "_since_last", "_buy_days_90", "history_days", n.cast("double").alias("purchase_days_180d"),
        *[c(f"days_since_{k}_purchase", year).alias(f"days_since_{k}_purchase") for k in ("first", "second_last", "third_last")],
        c("number_of_observed_gaps", 0.0).alias("number_of_observed_gaps"),
        *[c(f"{k}_interpurchase_gap", half).alias(f"{k}_interpurchase_gap")
          for k in ("last", "previous", "mean", "median", "min", "max", "p25", "p75")],
        c("std_interpurchase_gap", 0.0).alias("std_interpurchase_gap"),
        c("longest_inactivity_streak", half).alias("longest_inactivity_streak"),
        *[c(f"active_weeks_{k}d", 0.0).alias(f"active_weeks_{k}d") for k in (30, 90, 180)],
        c("history_span", 0.0).alias("_span"),
        *[flag(n >= k, "double").alias(f"has_{k}_purchase_days") for k in (2, 3)],
        flag(enough, "double").alias("cycle_estimate_available"),
    )
    has_rows = F.col("history_days") > 0
    std, mean, median = (F.col(f"{k}_interpurchase_gap") for k in ("std", "mean", "median"))
    since, ready = F.col("_since_last"), F.col("cycle_estimate_available") > 0.5
    if_ready = lambda x: F.when(ready, x).otherwise(F.lit(0.0))
    weeks = F.when(has_rows, F.col("active_weeks_180d")).otherwise(F.lit(1.0))
    return filled.withColumns({
        "share_of_weeks_with_purchase_90d": F.col("_buy_days_90") / F.lit(13.0),
        "share_of_weeks_with_purchase_180d": F.col("purchase_days_180d") / F.lit(26.0),
        "mean_active_streak": F.col("history_days") / (weeks + F.lit(1e-4)),
        "purchase_week_regularness": F.lit(1.0) / (std + F.lit(1.0)),
        "active_week_entropy": F.col("active_weeks_180d") / F.lit(26.0),
        "is_history_censored": flag(F.col("_span") < 180, "double"),
        "cv_interpurchase_gap": ratio(std, mean, 1e-4),
        "trend_interpurchase_gap": ratio("last_interpurchase_gap", "previous_interpurchase_gap", 1e-4),
        "gap_ratio": if_ready(ratio(since, median, 1e-4)),
        "overdue_days": if_ready(since - median),
        "gap_zscore": if_ready((since - mean) / (std + F.lit(1e-4))),
        "is_cycle_overdue": flag(ready & (since > median), "double"),
    }).drop("_since_last", "_buy_days_90", "history_days", "_span")


def personal_propensity(log: DataFrame, anchors: DataFrame, past_anchors: DataFrame | None = None, users: DataFrame | None = None,
                        horizon: int = 30, buy_prior: float = 0.5398, react_prior: float = 0.28,
                        churn_prior: float = 0.26, churn_prior_alone: float = 0.257) -> DataFrame:
    """Buy rates of a user over the target windows that ended by the anchor.

    Each past window is summed once per user; the windows then meet the anchors,
    so the log is read once whatever the number of anchor pairs. Only the days of some window
    are read, and all steps keep the one shuffle by user.
    """
    past_anchors = anchors if past_anchors is None else past_anchors
    windows = past_anchors.select(F.col("anchor_date").alias("_w")).distinct()
    dates = anchors.select("anchor_date").distinct()
    known = F.date_add("_w", horizon) <= F.col("anchor_date")
    # anchors with their windows, and with a null window for the index rows
    legal = dates.join(F.broadcast(windows), known, "left").withColumn("_n", F.count("_w").over(Window.partitionBy("anchor_date")))
    pairs = legal.where("_w IS NOT NULL").unionByName(legal.groupBy("anchor_date").agg(F.lit(None).cast("date").alias("_w"), F.first("_n").alias("_n")))
    # the index rows meet no window but one null row, so anchors without windows have them too
    nowhere = F.lit(None).cast("date")
    days = days_from(windows.select(F.col("_w").alias("anchor_date")), 1, horizon).where("_day IS NOT NULL").unionByName(
        windows.agg(nowhere.alias("anchor_date"), nowhere.alias("_day")))
    rows = with_index(log, log if users is None else users, ["gmv"], days)
    sums = rows.groupBy("user_id", F.col("anchor_date").alias("_w")).agg(F.sum("gmv").alias("_g"), F.max("_index").alias("_index"))
    own = F.broadcast(pairs.withColumnRenamed("_w", "_window"))
    counted = sums.join(own, F.col("_w").eqNullSafe(F.col("_window"))).groupBy("user_id", "anchor_date").agg(
        count_where(F.col("_g") > 0).alias("_k"), F.sum(F.log1p("_g")).alias("_z"), F.max("_n").alias("_n"), F.max("_index").alias("_index"))
    full = counted.where("_index")
    n, k = F.col("_n").cast("double"), F.coalesce(F.col("_k"), F.lit(0)).cast("double")
    some = F.col("_n") > 0
    smooth = lambda hits, prior, m: (hits + F.lit(m * prior)) / (n + F.lit(m))
    return full.select(
        *KEYS,
        F.when(some, k / F.greatest(n, F.lit(1.0))).otherwise(F.lit(0.0)).alias("personal_buy_rate_raw"),
        *[smooth(k, buy_prior, m).alias(f"personal_buy_rate_{name}") for name, m in SMOOTHING.items()],
        smooth(k, react_prior, 5.0).alias("personal_react_rate_k5"),
        F.when(some, smooth(n - k, churn_prior, 5.0)).otherwise(F.lit(churn_prior_alone)).alias("personal_churn_rate_k5"),
        F.when(k > 0, F.col("_z") / F.greatest(k, F.lit(1.0))).otherwise(F.lit(0.0)).alias("personal_mean_log_gmv"),
        n.alias("n_completed_past_target_windows"),
        flag(some, "double").alias("propensity_available_flag"),
    )


def _window_sums(log: DataFrame, starts: DataFrame, users: DataFrame | None, exprs: list[Column], horizon: int) -> DataFrame:
    """Aggregate the log over ``[_from, _from + horizon - 1]`` of each anchor, on the full index.

    ``starts`` (anchor_date, _from) meet the log by day; days of no window are not read. ``_available`` says that the log reaches back to the window.
    """
    rows = with_index(log, log if users is None else users, ["gmv", "to_ord", "searches", "to_cart"], days_from(starts, 0, horizon - 1, "_from"))
    found = rows.groupBy(*KEYS).agg(F.max("_index").alias("_index"), *exprs).where("_index").drop("_index")
    known = starts.select("anchor_date", flag(F.col("_from") >= log.agg(F.min("event_date")).scalar(), "double").alias("_available"))
    return found.join(F.broadcast(known), "anchor_date")


def last_year_exact(log: DataFrame, anchors: DataFrame, users: DataFrame | None = None, horizon: int = 30, shift: int = 365) -> DataFrame:
    """What the user did in the target window 365 days earlier."""
    starts = anchors.select("anchor_date", F.date_add("anchor_date", 1 - shift).alias("_from"))
    real = ~F.col("_index")
    sums = _window_sums(log, starts, users, [
        sum_where(real, "gmv").alias("_gmv"),
        count_where(real & purchase()).alias("purchase_days"),
        sum_where(real, "to_ord").alias("orders"),
        sum_where(real, "searches").alias("searches"),
        sum_where(real, "to_cart").alias("carts"),
        count_where(real).alias("active_days"),
    ], horizon)
    known = F.col("_available") > 0
    keep = lambda x: F.when(known, x.cast("double")).otherwise(F.lit(0.0))
    p = "ly_exact_target_"
    return sums.select(
        *KEYS,
        keep(flag(F.col("_gmv") > 0)).alias(p + "buy"), keep(F.col("_gmv")).alias(p + "gmv"),
        keep(log_amount("_gmv")).alias(p + "log_gmv"),
        *[keep(F.col(c)).alias(p + c) for c in ("purchase_days", "orders", "searches", "carts", "active_days")],
        F.col("_available").alias(p + "available"),
    )


def last_year_calendar(log: DataFrame, anchors: DataFrame, users: DataFrame | None = None, horizon: int = 30) -> DataFrame:
    """The same for the anchor moved by a calendar year (29 Feb becomes 28 Feb)."""
    starts = anchors.select("anchor_date", F.date_add(F.add_months("anchor_date", -12), 1).alias("_from"))
    real = ~F.col("_index")
    p = "ly_target_window_"
    sums = _window_sums(log, starts, users, [
        flag(sum_where(real, "gmv") > 0, "double").alias(p + "buyer"),
        sum_where(real, "gmv").alias(p + "gmv"),
        sum_where(real, "to_ord").alias(p + "orders"),
        count_where(real & positive("to_ord")).alias(p + "purchase_days"),
        count_where(real).alias(p + "active_days"),
        sum_where(real, "searches").alias(p + "searches"),
        sum_where(real, "to_cart").alias(p + "carts"),
    ], horizon)
    values = [c for c in sums.columns if c.startswith(p)]
    return sums.select(
        *KEYS, F.col("_available").alias("ly_window_available"),
        *[F.when(F.col("_available") > 0, F.col(c).cast("double")).otherwise(F.lit(0.0)).alias(c) for c in values],
    )


def lifecycle_features(log: DataFrame, anchors: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Recency with missing flags, short windows, decay and intent over one year of history."""
    hist = history(log, anchors, users, back=365, columns=list(SHORT_METRICS))
    base = aggregate(hist, [
        *recency_exprs(), *short_window_exprs(),
        F.coalesce(F.max(F.when(past(), F.col("age"))), F.lit(0)).cast("double").alias("user_tenure_days"),
        *[count_where(within(n)).cast("double").alias(f"active_days_{n}d") for n in (30, 90)],
        *[count_where(within(n) & positive("to_ord")).cast("double").alias(f"purchase_days_{n}d") for n in (30, 90)],
    ])
    return decay_intent(missing_flags(base))


def transition_feature_set(log: DataFrame, anchors: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Lifecycle, calendar-year analogue and calendar context in one frame."""
    return (
        lifecycle_features(log, anchors, users)
        .join(last_year_calendar(log, anchors, users), KEYS, "left")
        .join(F.broadcast(calendar_context(anchors)), "anchor_date")
    )


def activity_window_report(log: DataFrame, anchors: DataFrame, users: DataFrame | None = None, windows=(30, 60, 90),
                           horizon: int = 30) -> DataFrame:
    """Size and purchases of the active cohort under each window length, and the
    users (and buyers) it gains over the next shorter window."""
    hist = history(log, anchors, users, back=max(windows), ahead=horizon, columns=["gmv"])
    per_user = aggregate(hist, [
        *[flag(sum_where(within(n), "gmv") > 0).alias(f"_a{n}") for n in windows],
        sum_where(F.col("age") < 0, "gmv").alias("_future"),
    ])
    shorter = dict(zip(windows[1:], windows[:-1]))
    options = F.array(*[
        F.struct(F.lit(n).alias("window_days"), F.col(f"_a{n}").alias("active"),
                 (F.col(f"_a{shorter[n]}") if n in shorter else F.lit(0)).alias("inner"))
        for n in windows
    ])
    rows = per_user.select("anchor_date", "_future", F.explode(options).alias("o")).select("anchor_date", "_future", "o.*")
    active, buys = F.col("active") == 1, F.col("_future") > 0
    gained = active & (F.col("inner") == 0)
    state = lambda p, f: (F.col("active") == p) & (buys if f else ~buys)
    return rows.groupBy("anchor_date", "window_days").agg(
        F.count(F.lit(1)).alias("n_users"),
        count_where(active).alias("n_active"),
        count_where(gained).alias("n_borderline"),
        count_where(gained & buys).alias("n_borderline_buyers"),
        *[count_where(state(p, f)).alias(f"n_{p}{f}") for p in (0, 1) for f in (0, 1)],
        sum_where(state(0, 1), "_future").alias("reactivated_amount"),
        sum_where(state(1, 1), "_future").alias("retained_amount"),
    )
