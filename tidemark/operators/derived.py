"""Projections on feature frames: ratios, flags, segments, scaling, column rules."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import clip, flag, ratio
from tidemark.operators.history import KEYS

RATE_BASES = ["gmv_sum", "to_ord_sum", "to_cart_sum", "searches_sum", "active_days", "purchase_days", "search_days", "cart_days"]
RATE_PAIRS = [(7, 30), (14, 60), (30, 90)]
TECHNICAL = ["anchor_date", "user_id", "history_start", "history_end", "target_start", "target_end", "available_history_days"]
TARGETS = ["target", "will_buy_30d", "z_target", "target_z"]


def rates_ratios(df: DataFrame, bases=RATE_BASES, days=(7, 14, 30, 60, 90), eps: float = 1e-5) -> DataFrame:
    """Daily rates, rate differences, short/long ratios and their zero-denominator flags."""
    out: dict[str, str] = {}
    for base in bases:
        name = base.removesuffix("_sum")
        at = lambda n: f"{base}_{n}d"
        for n in days:
            out[f"{name}_rate_{n}d"] = f"{at(n)} / {float(n)}D"
        for short, long in RATE_PAIRS:
            out[f"{name}_rate_diff_{short}_{long}d"] = f"{at(short)} / {float(short)}D - {at(long)} / {float(long)}D"
            out[f"{name}_ratio_{short}_{long}d"] = f"{at(short)} / ({at(long)} + {eps}D)"
            out[f"{name}_is_zero_denom_{short}_{long}d"] = f"if({at(long)} = 0, 1D, 0D)"
    return df.selectExpr("*", *[f"{x} AS {n}" for n, x in out.items()])


def interval_vs_platform(df: DataFrame, n_users: float | Column, eps: float = 1e-5) -> DataFrame:
    """Approximate order interval, recency against it, and the user against the platform."""
    interval = F.lit(90.0) / (F.col("purchase_days_90d") + F.lit(eps))
    return df.withColumns({
        "approx_order_interval_90d": interval,
        "recency_ratio_90d": ratio("days_since_last_order", interval, eps),
        "user_gmv_vs_global_30d": ratio("gmv_sum_30d", "global_gmv_per_active_30d", eps),
        "user_active_vs_global_30d": ratio(
            "active_days_30d", F.col("global_dau_30d_mean") * F.lit(30.0) / F.lit(n_users).cast("double"), eps),
    })


def user_segment(df: DataFrame, new_days: int = 30, dormant_days: int = 90, active_days: int = 14) -> DataFrame:
    """0 new, 1/2 never bought and active/dormant, 3/4 buyer active/dormant, 5 away."""
    gone = F.col("days_since_last_activity")
    recent = gone <= active_days
    by_history = F.when(F.col("has_ever_ordered") == 0, F.when(recent, 1).otherwise(2)).otherwise(F.when(recent, 3).otherwise(4))
    return df.withColumn(
        "user_segment_id",
        F.when(F.col("customer_age_days") < new_days, 0).when(gone >= dormant_days, 5).otherwise(by_history),
    )


def behaviour_features(df: DataFrame) -> DataFrame:
    """Cycle, intent, ticket, funnel, channel, momentum and velocity ratios of the sparse snapshot."""
    since, age = F.col("days_since_last_order"), F.col("customer_age_days")
    order_days = F.col("order_days_365d")
    df = df.withColumn(
        "mean_order_interval_365d",
        clip((age - since) / F.when(order_days > 1, order_days - 1).otherwise(F.lit(1.0)), 1, 365),
    )
    interval = F.col("mean_order_interval_365d")
    out: dict[str, Column] = {
        "recency_to_cadence_ratio": clip(since / interval, 0, 50),
        "cycle_phase": clip((since % interval) / interval, 0, 1),
        "is_cycle_due_30d": flag(since + 30 >= interval, "double"),
        "is_overdue": flag(since > interval * 1.5, "double"),
    }
    for name, other in {"search_without_order_gap": "activity", "cart_intent_gap": "cart", "cat_without_order_gap": "cat"}.items():
        out[name] = clip(since - F.col(f"days_since_last_{other}"), 0, 999)

    s = lambda name, n: F.col(f"{name}_sum_{n}d")
    d = lambda name, n: F.col(f"{name}_days_{n}d")
    rate = lambda num, den, top: clip(ratio(num, den, 0.1), 0, top)
    ticket = lambda n: rate(s("gmv", n), s("orders", n), 1e5)
    raw_ticket = lambda n: ratio(s("gmv", n), s("orders", n), 0.1)
    for n in (365, 90, 30, 7):
        out[f"mean_ticket_gmv_{n}d"] = ticket(n)
    out["max_to_mean_gmv_ratio"] = clip(ratio("max_single_day_gmv_365d", raw_ticket(365), 1.0), 0, 50)
    out["gmv_to_search_ratio_90d"] = clip(ratio(s("gmv", 90), s("searches", 90), 1.0), 0, 1e4)
    for short, long in ((30, 90), (7, 30)):
        out[f"ticket_growth_{short}_to_{long}"] = clip(ratio(raw_ticket(short), raw_ticket(long), 1.0), 0, 20)

    out["active_to_cart_rate_90d"] = rate(d("cart", 90), d("active", 90), 1)
    out["cart_to_order_rate_90d"] = rate(d("order", 90), d("cart", 90), 10)
    out["cart_to_search_ratio_30d"] = rate(d("cart", 30), d("active", 30), 10)
    for n in (90, 30, 7):
        out[f"cart_drop_intensity_{n}d"] = clip(s("carts", n) - s("orders", n), 0, 9999)
        out[f"cat_share_of_browsing_{n}d"] = rate(s("cat", n), s("searches", n) + s("cat", n), 1)
        out[f"search_to_order_rate_{n}d"] = rate(s("search_orders", n), s("searches", n), 10)
    for n in (30, 7):
        out[f"cart_conversion_rate_{n}d"] = rate(s("orders", n), s("carts", n), 10)
    for n in (90, 30):
        out[f"cat_gmv_share_{n}d"] = rate(s("gmv_cat", n), s("gmv", n), 1)
        out[f"search_to_cart_rate_{n}d"] = rate(s("search_carts", n), s("searches", n), 10)
        out[f"cat_to_order_rate_{n}d"] = rate(s("cat_orders", n), s("cat", n), 10)
        out[f"cat_to_cart_rate_{n}d"] = rate(s("cat_carts", n), s("cat", n), 10)
    out["search_gmv_share_90d"] = rate(s("gmv_search", 90), s("gmv", 90), 1)
    even = lambda a, b: clip((a + F.lit(0.1)) / (b + F.lit(0.1)), 0, 50)
    out["search_vs_cat_order_ratio_90d"] = even(s("search_orders", 90), s("cat_orders", 90))
    out["search_vs_cat_gmv_ratio_90d"] = even(s("gmv_search", 90), s("gmv_cat", 90))

    for name, m in {"search": "searches", "cart": "carts", "gmv": "gmv", "cat": "cat"}.items():
        out[f"{name}_momentum_7_to_30"] = rate(F.col(f"ewma_{m}_tau7"), F.col(f"ewma_{m}_tau30"), 20)
    decayed = lambda get, c: clip(get(14) / (get(60) * F.lit(14.0 / 60.0) + F.lit(c)), 0, 20)
    out["searches_decay_14_to_60"] = decayed(lambda n: s("searches", n), 1.0)
    out["orders_decay_14_to_60"] = decayed(lambda n: s("orders", n), 0.1)
    out["cart_decay_14_to_60"] = decayed(lambda n: d("cart", n), 0.1)
    paces = {"order": (d, "order", 0.1), "cart": (d, "cart", 0.1), "searches": (s, "searches", 1.0), "gmv": (s, "gmv", 1.0)}
    for name, (get, m, c) in paces.items():
        out[f"{name}_velocity_30_to_90"] = get(m, 30) / (get(m, 90) / F.lit(3.0) + F.lit(c))
        out[f"{name}_velocity_7_to_30"] = get(m, 7) / (get(m, 30) * F.lit(7.0 / 30.0) + F.lit(c))

    out["is_searching_dormant"] = flag((since > 30) & (F.col("days_since_last_activity") <= 7), "double")
    out["is_carting_dormant"] = flag((since > 30) & (F.col("days_since_last_cart") <= 14), "double")
    per_age = lambda x, top: clip(x / (age + F.lit(1.0)), 0, top)
    out["dormant_search_density"] = per_age(s("searches", 30), 100)
    out["order_density_lifetime"] = per_age(order_days, 1)
    out["active_density_lifetime"] = per_age(F.col("lifetime_active_days"), 1)
    return df.select("*", *[c.alias(n) for n, c in out.items()])


def decay_intent(df: DataFrame, eps: float = 1e-4) -> DataFrame:
    """Short against long sums, unfinished funnels and accelerations."""
    v = lambda m, n: F.col(f"{m}_{n}d")
    weeks_in_month = F.lit(4.2857)
    out: dict[str, Column] = {}
    for m in ("searches", "carts", "orders", "gmv"):
        out[f"decay_{m}_7d_vs_30d"] = ratio(v(m, 7), v(m, 30), eps)
    for m in ("searches", "carts"):
        out[f"decay_{m}_3d_vs_14d"] = ratio(v(m, 3), v(m, 14), eps)
        out[f"diff_{m}_7d_norm_30d"] = v(m, 7) - v(m, 30) / weeks_in_month
    for m in ("orders", "gmv"):
        out[f"diff_{m}_14d_norm_60d"] = v(m, 14) - v(m, 60) / weeks_in_month
    for n in (7, 3):
        for name, m in {"search": "searches", "cart": "carts"}.items():
            out[f"intent_{name}_without_order_{n}d"] = flag((v(m, n) > 0) & (v("orders", n) == 0), "double")
        out[f"intent_unfinished_funnel_{n}d"] = v("carts", n) - v("orders", n)
    for name, m in {"search": "searches", "cart": "carts"}.items():
        out[f"intent_{name}_accel_3d_vs_14d"] = (v(m, 3) / F.lit(3.0)) / (v(m, 14) / F.lit(14.0) + F.lit(eps))
    return df.select("*", *[c.alias(n) for n, c in out.items()])


def missing_flags(df: DataFrame, names=("activity", "search", "cart", "order"), sentinel: float = 365.0) -> DataFrame:
    """Is-missing flags beside the filled recency columns."""
    flags = {f"is_missing_last_{n}": flag(F.col(f"days_since_last_{n}").isNull(), "double") for n in names}
    filled = {f"days_since_last_{n}": F.coalesce(F.col(f"days_since_last_{n}").cast("double"), F.lit(sentinel)) for n in names}
    return df.withColumns(flags).withColumns(filled)


def feature_columns(df: DataFrame, drop_noisy: bool = False) -> list[str]:
    """Names a model may see: no keys, dates, targets; optionally no platform columns."""
    hidden = set(TECHNICAL) | set(TARGETS)
    names = [c for c in df.columns if c not in hidden and not c.startswith(("target_z", "future_", "will_buy"))]
    return [c for c in names if not (drop_noisy and c.startswith("global_"))]


# First matching rule gives the group of a feature name.
CATALOG_RULES = [
    ("btyd", r"^(btyd_|gamma_gamma)"),
    ("calendar", r"^(cal_|target_|anchor_|sin_doy|cos_doy|number_of_holidays|days_to_)"),
    ("platform", r"(^global_|_vs_global_)"),
    ("last_year", r"^ly_"),
    ("propensity", r"^(personal_|propensity_|n_completed)"),
    ("recency", r"^(days_since_|customer_age|recency_|is_missing_)"),
    ("cadence", r"(interpurchase|cycle|gap|overdue|streak|weeks|interval)"),
    ("dynamics", r"^(ts_|ewma_|decay_|diff_|intent_)"),
    ("monetary", r"gmv"),
    ("orders", r"(to_ord|order|purchase)"),
    ("cart", r"cart"),
    ("search", r"search"),
    ("activity", r"active"),
]


def feature_group(name: str) -> str:
    return next((group for group, rule in CATALOG_RULES if re.search(rule, name)), "other")


SKETCH = 256  # smallest hashes kept to count distinct values


def column_summaries(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: rows, missing, zeros, range, sum, and distinct values, in one pass.

    A task keeps one mergeable state per column (counts, range, the ``SKETCH`` smallest hashes of its values) and gives it out at its end,
    so neither the rows nor an aggregate is as wide as the table times the measures. ``n_distinct`` is exact below ``SKETCH``
    values and an estimate (some 6 % off) from there. NaN counts as missing, values below 1e-9 in size as zeros.
    """
    names = list(columns)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), 4))  # rows, missing, zeros, sum
        low, high, seen = np.full(len(names), np.inf), np.full(len(names), -np.inf), [np.zeros(0, np.uint64)] * len(names)
        for batch in batches:
            for i in range(len(names)):
                x = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
                real = x[~np.isnan(x)] + 0.0
                total[i] += len(x), len(x) - len(real), (np.abs(real) < 1e-9).sum(), real.sum()
                if len(real):
                    low[i], high[i] = min(low[i], real.min()), max(high[i], real.max())
                    bits = np.unique(real).view(np.uint64)
                    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):  # mixes all bits into all others
                        bits = (bits ^ (bits >> np.uint64(shift))) * np.uint64(factor)
                    seen[i] = np.unique(np.concatenate([seen[i], bits]))[:SKETCH]
        yield pa.RecordBatch.from_pydict({
            "feature": names, "n": total[:, 0], "missing": total[:, 1], "zeros": total[:, 2], "total": total[:, 3],
            "low": pa.array(low, mask=np.isinf(low)), "high": pa.array(high, mask=np.isinf(high)),
            "seen": pa.array([(h >> np.uint64(1)).astype(np.int64).tolist() for h in seen], pa.list_(pa.int64()))})

    found = df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(
        states, "feature string, n double, missing double, zeros double, total double, low double, high double, seen array<long>")
    merged = found.groupBy("feature").agg(
        *[F.sum(c).alias(c) for c in ("n", "missing", "zeros", "total")], F.min("low").alias("low"), F.max("high").alias("high"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("seen")))), 1, SKETCH).alias("seen"))
    known = F.col("n") - F.col("missing")
    estimate = F.when(F.size("seen") < SKETCH, F.size("seen").cast("double")).otherwise(F.lit(float(SKETCH - 1)) * F.lit(2.0 ** 63) / F.element_at("seen", -1))
    return merged.select("feature", F.col("n").cast("long").alias("n_rows"), F.col("missing").cast("long").alias("n_missing"), F.col("zeros").cast("long").alias("n_zero"),
                         F.col("low").alias("least"), F.col("high").alias("greatest"), F.when(known > 0, F.col("total") / known).alias("mean"), estimate.alias("n_distinct"))


def feature_catalog(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Every feature of a wide table with its group and what its values are; ``varies`` says that a model can learn from it."""
    names = feature_columns(df) if columns is None else list(columns)
    group = reduce(lambda rest, rule: F.when(F.col("feature").rlike(rule[1]), rule[0]).otherwise(rest), reversed(CATALOG_RULES), F.lit("other"))
    return column_summaries(df, names).select("feature", group.alias("feature_group"), "n_rows", "n_missing", "n_zero", "least", "greatest", "mean", "n_distinct",
                                              flag(F.col("least") < F.col("greatest")).alias("varies"))


def finite(c) -> Column:
    """The value, or 0 where it is null, NaN or infinite."""
    x = c.cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def fit_scaler(train: DataFrame, columns: list[str], floor: float = 1e-6) -> DataFrame:
    """One row with mean and population deviation of each column over the train rows."""
    aggs = [F.avg(finite(F.col(c))).alias(f"{c}__mean") for c in columns]
    aggs += [F.greatest(F.stddev_pop(finite(F.col(c))), F.lit(floor)).alias(f"{c}__std") for c in columns]
    return train.agg(*aggs)


def standardise_features(df: DataFrame, scaler: DataFrame, columns: list[str], bound: float = 8.0) -> DataFrame:
    """Centre and scale with a one-row scaler, then clip to ``+-bound``."""
    wide = df.crossJoin(F.broadcast(scaler))  # scaler is a single row
    scaled = {c: clip((finite(F.col(c)) - F.col(f"{c}__mean")) / F.col(f"{c}__std"), -bound, bound) for c in columns}
    return wide.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])
