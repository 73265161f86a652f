"""Windowed aggregates per (anchor, user), and daily or lifetime roll-ups.

The ``*_exprs`` functions return aggregate columns over :func:`history` rows, so
any mixture of them is one aggregation over one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import flag
from tidemark.operators.anchors import holiday_distance
from tidemark.operators.history import aggregate, fill, history, within

# Window names with their first and last day before the anchor.
FOLD_WINDOWS = {"30d": (29, 0), "60d": (59, 0), "90d": (89, 0), "30_60d": (59, 30), "60_90d": (89, 60)}
FOLD_METRICS = ["gmv", "searches", "to_cart", "to_ord"]
FOLD_AGGS = ["sum", "max", "std", "mean"]
SNAPSHOT_DAYS = (7, 14, 30, 60, 90)
SNAPSHOT_METRICS = ["gmv", "to_ord", "to_cart", "searches", "search_to_cart", "search_to_ord", "cat_to_cart", "cat_to_ord"]
SPARSE_DAYS = (7, 14, 30, 60, 90, 180, 365)
SPARSE_METRICS = {"gmv": "gmv", "gmv_search": "gmv_search", "gmv_cat": "gmv_cat", "searches": "searches",
                  "to_ord": "orders", "to_cart": "carts", "cat": "cat", "search_to_ord": "search_orders",
                  "cat_to_ord": "cat_orders", "search_to_cart": "search_carts", "cat_to_cart": "cat_carts"}
DIRECT_METRICS = ["gmv", "to_ord", "to_cart", "searches", "search_to_ord", "cat_to_ord"]
SHORT_DAYS = (3, 7, 14, 30, 60)
SHORT_METRICS = {"searches": "searches", "to_cart": "carts", "to_ord": "orders", "gmv": "gmv"}


# The wide aggregate lists are written as SQL text: one parsed expression per column
# instead of a dozen driver calls each.
ANY_ACTIVITY = "searches > 0 or to_cart > 0 or to_ord > 0 or gmv > 0"
ANY_ACTIVITY_WITH_CATALOGUE = ANY_ACTIVITY + " or cat > 0"
PURCHASE = "to_ord > 0 or gmv > 0"


def positive(c: str) -> Column:
    return F.col(c) > 0


def purchase() -> Column:
    return F.expr(PURCHASE)


def last_seen(cond: str = "true") -> Column:
    """Days since the last past row with ``cond`` (the smallest age)."""
    return F.expr(f"min(if(age >= 0 and ({cond}), age, null))")


def sum_in(metric: str, n: int, skip: int = 0, cond: str = "true") -> str:
    """Sum over the window of ``n`` days that ends ``skip`` days before the anchor, 0 when empty."""
    return f"cast(coalesce(sum(if(age between {skip} and {skip + n - 1} and ({cond}), {metric}, null)), 0) as double)"


def days_in(cond: str, n: int) -> str:
    return f"count(if(age between 0 and {n - 1} and ({cond}), 1, null))"


def named(text: str, name: str) -> Column:
    return F.expr(text).alias(name)


# --- aggregate lists ------------------------------------------------------------------------

def window_agg_exprs(windows=FOLD_WINDOWS, metrics=FOLD_METRICS, aggs=FOLD_AGGS) -> list[Column]:
    """metric x aggregate x window; empty windows give null except for sum and count."""
    forms = {"sum": "cast(coalesce(sum({x}), 0) as double)", "max": "cast(max({x}) as double)", "std": "stddev_samp({x})",
             "mean": "avg({x})", "count": "count({x})"}
    unknown = set(aggs) - set(forms)
    if unknown:
        raise ValueError(f"unknown aggregates: {sorted(unknown)}")
    return [named(forms[g].format(x=f"if(age between {last} and {first}, {m}, null)"), f"{m}_{g}_{name}")
            for name, (first, last) in windows.items() for m in metrics for g in aggs]


def recency_exprs() -> list[Column]:
    conds = {"activity": "true", "search": "searches > 0", "cart": "to_cart > 0", "order": "to_ord > 0"}
    return [last_seen(c).alias(f"days_since_last_{name}") for name, c in conds.items()]


def fold_recency_exprs() -> list[Column]:
    return recency_exprs() + [
        last_seen("gmv > 0").alias("days_since_last_positive_gmv"),
        *[named(days_in("true", n), f"active_days_{n}d") for n in (30, 90)],
    ]


def window_activity_exprs(days=SNAPSHOT_DAYS, metrics=SNAPSHOT_METRICS, eps: float = 1e-5) -> list[Column]:
    """Day counts and five aggregates per metric; max and std are 0 on an empty window."""
    kinds = {"active": ANY_ACTIVITY, "purchase": PURCHASE, "search": "searches > 0", "cart": "to_cart > 0"}
    out: list[Column] = []
    for n in days:
        out += [named(days_in(cond, n), f"{kind}_days_{n}d") for kind, cond in kinds.items()]
        for m in metrics:
            total, inside = sum_in(m, n), f"if(age between 0 and {n - 1}, {m}, null)"
            out += [
                named(total, f"{m}_sum_{n}d"),
                named(f"{total} / {float(n)}D", f"{m}_mean_cal_{n}d"),
                named(f"{total} / ({days_in(m + ' > 0', n)} + {eps}D)", f"{m}_mean_act_{n}d"),
                named(f"greatest(cast(max({inside}) as double), 0D)", f"{m}_max_{n}d"),
                named(f"coalesce(stddev_samp({inside}), 0D)", f"{m}_std_cal_{n}d"),
            ]
    return out


def sparse_window_exprs(days=SPARSE_DAYS, metrics=SPARSE_METRICS) -> list[Column]:
    kinds = {"active": ANY_ACTIVITY_WITH_CATALOGUE, "order": PURCHASE, "cart": "to_cart > 0", "cat": "cat > 0"}
    out: list[Column] = []
    for n in days:
        out += [named(days_in(cond, n), f"{kind}_days_{n}d") for kind, cond in kinds.items()]
        out += [named(sum_in(m, n), f"{name}_sum_{n}d") for m, name in metrics.items()]
    return out


def direct_window_exprs(days=SPARSE_DAYS, metrics=DIRECT_METRICS) -> list[Column]:
    kinds = {"active": ANY_ACTIVITY, "order": "to_ord > 0", "cart": "to_cart > 0", "search": "searches > 0"}
    out: list[Column] = []
    for n in days:
        out += [named(sum_in(m, n), f"direct_{m}_sum_{n}d") for m in metrics]
        out += [named(days_in(cond, n), f"direct_{kind}_days_{n}d") for kind, cond in kinds.items()]
    return out + [
        named("max(if(age >= 0, age, null))", "direct_history_age_days"),
        named(f"count(if(age >= 0 and ({ANY_ACTIVITY}), 1, null))", "direct_lifetime_active_days"),
        last_seen().alias("direct_days_since_activity"),
        last_seen("to_ord > 0").alias("direct_days_since_order"),
        last_seen("gmv > 0").alias("direct_days_since_positive_gmv"),
    ]


def lifetime_exprs() -> list[Column]:
    return [
        named("max(if(age >= 0, age, null))", "customer_age_days"),
        *recency_exprs(),
        named("max(if(age >= 0 and to_ord > 0, 1, 0))", "has_ever_ordered"),
        *[named(f"cast(coalesce(sum(if(age >= 0, {m}, null)), 0) as double)", name)
          for m, name in {"to_ord": "lifetime_orders", "gmv": "lifetime_gmv"}.items()],
        named("count(if(age >= 0 and to_ord > 0, 1, null))", "lifetime_purchase_days"),
    ]


def sparse_lifetime_exprs() -> list[Column]:
    conds = {"activity": "true", "order": PURCHASE, "cart": "to_cart > 0", "gmv": "gmv > 0", "cat": "cat > 0"}
    return [
        *[last_seen(c).alias(f"days_since_last_{name}") for name, c in conds.items()],
        named("max(if(age >= 0, age, null))", "customer_age_days"),
        named(f"count(if(age >= 0 and ({ANY_ACTIVITY_WITH_CATALOGUE}), 1, null))", "lifetime_active_days"),
        named("greatest(max(if(age between 0 and 364, gmv, null)), 0D)", "max_single_day_gmv_365d"),
    ]


def ewma_exprs(metrics=None, taus=(7, 30), days: int = 365) -> list[Column]:
    metrics = metrics or {"searches": "searches", "to_cart": "carts", "gmv": "gmv", "cat": "cat"}
    return [named(sum_in(f"{m} * exp(-age / {float(t)}D)", days), f"ewma_{name}_tau{t}")
            for m, name in metrics.items() for t in taus]


def dynamics_exprs(eps: float = 1e-5) -> list[Column]:
    """Shape of the 90-day amounts. The spike count needs ``_mean90``, see :func:`with_spike_mean`."""
    amounts = "if(age between 0 and 89, gmv, null)"
    mean = f"({sum_in('gmv', 90)} / 90D)"
    weekend = "weekday(event_date) >= 5"
    recent_vs_before = lambda m: f"{sum_in(m, 14)} / ({sum_in(m, 31, 14)} / 2D + {eps}D)"
    texts = {
        "ts_gmv_spike_count_90d": days_in("gmv > _mean90 * 2.5D", 90),
        "ts_active_conversion_efficiency": f"{days_in('gmv > 0', 90)} / ({days_in('searches > 0', 90)} + {eps}D)",
        "ts_gmv_acceleration_ratio": recent_vs_before("gmv"),
        "ts_search_acceleration_ratio": recent_vs_before("searches"),
        "ts_weekend_bias_ratio": f"{sum_in('gmv', 90, cond=weekend)} / ({sum_in('gmv', 90, cond=f'not ({weekend})')} / 2.5D + {eps}D)",
        "ts_peak_to_mean_gmv_90d": f"greatest(max({amounts}), 0D) / ({mean} + {eps}D)",
        "ts_gmv_volatility_coef_90d": f"coalesce(stddev_samp({amounts}), 0D) / ({mean} + {eps}D)",
        "ts_gmv_skewness_90d": f"coalesce(skewness({amounts}), 0D)",
        "ts_gmv_kurtosis_90d": f"coalesce(kurtosis({amounts}), 0D)",
    }
    return [named(text, name) for name, text in texts.items()]


def with_spike_mean(hist: DataFrame) -> DataFrame:
    """Mean daily amount of the 90 days beside every row. A user has at most one
    row per day, so the frame is bounded, and the user partitioning is reused."""
    per_user = Window.partitionBy("user_id", "anchor_date")
    return hist.withColumn("_mean90", F.coalesce(F.sum(F.when(within(90), F.col("gmv"))).over(per_user), F.lit(0.0)) / 90.0)


def short_window_exprs(days=SHORT_DAYS, metrics=SHORT_METRICS) -> list[Column]:
    return [named(sum_in(m, n), f"{name}_{n}d") for n in days for m, name in metrics.items()]


# --- operators ------------------------------------------------------------------------------

def window_aggs(log, anchors, users=None, windows=FOLD_WINDOWS, metrics=FOLD_METRICS, aggs=FOLD_AGGS) -> DataFrame:
    back = max(first for first, _ in windows.values()) + 1
    return aggregate(history(log, anchors, users, back=back, columns=list(metrics)),
                     window_agg_exprs(windows, metrics, aggs))


def window_activity(log, anchors, users=None, days=SNAPSHOT_DAYS) -> DataFrame:
    return aggregate(history(log, anchors, users, back=max(days), columns=SNAPSHOT_METRICS), window_activity_exprs(days))


def sparse_window_sums(log, anchors, users=None, days=SPARSE_DAYS) -> DataFrame:
    return aggregate(history(log, anchors, users, back=max(days), columns=list(SPARSE_METRICS)), sparse_window_exprs(days))


def direct_window_sums(log, anchors, users=None, days=SPARSE_DAYS, sentinel: float = 366.0) -> DataFrame:
    ages = ["direct_history_age_days", "direct_days_since_activity", "direct_days_since_order", "direct_days_since_positive_gmv"]
    hist = history(log, anchors, users, back=max(days), columns=DIRECT_METRICS)
    return fill(aggregate(hist, direct_window_exprs(days)), sentinel, ages)


def recency(log, anchors, users=None, back: int | None = 90) -> DataFrame:
    cols = ["searches", "to_cart", "to_ord", "gmv"]
    return fill(aggregate(history(log, anchors, users, back=back, columns=cols), fold_recency_exprs()))


def lifetime(log, anchors, users=None, back: int | None = None) -> DataFrame:
    cols = ["searches", "to_cart", "to_ord", "gmv"]
    return fill(aggregate(history(log, anchors, users, back=back, columns=cols), lifetime_exprs()),
                recency_names=["customer_age_days"])


def ewma_decay(log, anchors, users=None, taus=(7, 30)) -> DataFrame:
    return aggregate(history(log, anchors, users, back=365, columns=["searches", "to_cart", "gmv", "cat"]), ewma_exprs(taus=taus))


def ts_dynamics(log, anchors, users=None) -> DataFrame:
    hist = with_spike_mean(history(log, anchors, users, back=90, columns=["gmv", "searches"]))
    return aggregate(hist, dynamics_exprs())


def short_window_sums(log, anchors, users=None) -> DataFrame:
    hist = history(log, anchors, users, back=365, columns=list(SHORT_METRICS))
    return aggregate(hist, short_window_exprs() + recency_exprs())


def daily_rollup(raw: DataFrame, sums: list[str], flags: list[str] = ()) -> DataFrame:
    """Several rows of one user and day become one; the sums combine before the shuffle."""
    return raw.groupBy("user_id", "event_date").agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in flags]
    )


def platform_daily(log: DataFrame, eps: float = 1e-5) -> DataFrame:
    """Users, buyers, amount, orders and four ratios per day.

    Each (date, user) is reduced before the date, so a day with most of the rows
    is still summed by many tasks.
    """
    per_user = log.groupBy("event_date", "user_id").agg(
        F.max(flag(purchase())).alias("_buys"), F.sum("gmv").alias("_gmv"), F.sum("to_ord").alias("_orders")
    )
    day = per_user.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("global_dau"), F.sum("_buys").alias("global_buyers"),
        F.sum("_gmv").alias("global_gmv"), F.sum("_orders").alias("global_orders"),
    )
    over = lambda a, b: F.col(f"global_{a}") / (F.col(f"global_{b}") + F.lit(eps))
    return day.withColumns({
        "global_buyer_rate": over("buyers", "dau"),
        "global_gmv_per_active": over("gmv", "dau"),
        "global_orders_per_buyer": over("orders", "buyers"),
        "global_gmv_per_order": over("gmv", "orders"),
    })


def platform_at_anchor(daily: DataFrame, anchors: DataFrame) -> DataFrame:
    """Means over the last 7 and 30 days that have rows, up to each anchor."""
    newest = Window.partitionBy("anchor_date").orderBy(F.desc("event_date"))
    ranked = anchors.join(F.broadcast(daily), F.col("event_date") <= F.col("anchor_date"), "left")  # one row per day
    ranked = ranked.withColumn("_r", F.row_number().over(newest))
    mean = lambda c, n: F.coalesce(F.avg(F.when(F.col("_r") <= n, F.col(c))), F.lit(0.0))
    return ranked.where(F.col("_r") <= 30).groupBy("anchor_date").agg(
        mean("global_dau", 7).alias("global_dau_7d_mean"),
        mean("global_dau", 30).alias("global_dau_30d_mean"),
        mean("global_gmv_per_active", 7).alias("global_gmv_per_active_7d"),
        mean("global_gmv_per_active", 30).alias("global_gmv_per_active_30d"),
        mean("global_buyer_rate", 30).alias("global_buyer_rate_30d"),
    )


def daily_totals(log: DataFrame, metrics: list[str]) -> DataFrame:
    return log.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("active_users"), *[F.sum(m).alias(f"{m}_total") for m in metrics]
    )


def user_totals(log: DataFrame) -> DataFrame:
    return log.groupBy("user_id").agg(
        F.sum("gmv").alias("lifetime_gmv"), F.count(F.lit(1)).alias("active_days"), F.max("gmv").alias("max_day_gmv"),
        F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day"),
    )


def cumulative_amount(log: DataFrame, column: str = "gmv") -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("event_date").rowsBetween(Window.unboundedPreceding, 0)
    return log.select("user_id", "event_date", F.col(column), F.sum(column).over(order).alias(f"cumulative_{column}"))


def money_funnel_ratios(df: DataFrame, eps: float = 1e-5) -> DataFrame:
    """Amount per order and active day, funnel conversion and 30-day trend."""
    r = lambda a, b: F.col(a) / (F.col(b) + F.lit(eps))
    out = {}
    for n in (90, 30):
        out[f"mean_gmv_per_order_{n}d"] = r(f"gmv_sum_{n}d", f"to_ord_sum_{n}d")
        out[f"mean_gmv_per_active_day_{n}d"] = r(f"gmv_sum_{n}d", f"active_days_{n}d")
        out[f"cart_conversion_rate_{n}d"] = r(f"to_cart_sum_{n}d", f"searches_sum_{n}d")
        out[f"order_conversion_rate_{n}d"] = r(f"to_ord_sum_{n}d", f"to_cart_sum_{n}d")
        out[f"search_to_order_rate_{n}d"] = r(f"to_ord_sum_{n}d", f"searches_sum_{n}d")
    for name, m in {"cart": "to_cart", "search": "searches", "gmv": "gmv"}.items():
        out[f"{name}_trend_30_60d"] = r(f"{m}_sum_30d", f"{m}_sum_30_60d")
    return df.withColumns(out)


def fold_features(log, anchors, users=None) -> DataFrame:
    """Window aggregates, recency, holiday distance and ratios of the fold data set."""
    hist = history(log, anchors, users, back=90, columns=FOLD_METRICS)
    table = fill(aggregate(hist, window_agg_exprs() + fold_recency_exprs()))
    return money_funnel_ratios(table.join(F.broadcast(holiday_distance(anchors)), "anchor_date"))
