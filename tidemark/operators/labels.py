"""Future-window labels and purchase states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import flag, log_amount, sum_where
from tidemark.operators.history import KEYS, aggregate, history, target_window, within

STATES = ["00", "01", "10", "11"]


def future_sum_target(log: DataFrame, anchors: DataFrame, users: DataFrame | None = None, horizon: int = 30,
                      column: str = "gmv", name: str = "target") -> DataFrame:
    """Sum over the ``horizon`` days after the anchor, 0 for users without rows."""
    hist = history(log, anchors, users, back=0, ahead=horizon, columns=[column])
    return aggregate(hist, [sum_where(target_window(horizon), column).alias(name)])


def log_target(log: DataFrame, start: str, end: str, users: DataFrame | None = None, column: str = "gmv") -> DataFrame:
    """``log1p`` of the amount between two dates, both included."""
    if end < start:
        raise ValueError("target end before target start")
    index = (log if users is None else users).select("user_id").distinct()
    inside = F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    sums = log.where(inside).groupBy("user_id").agg(F.sum(column).alias("_s"))
    return index.join(sums, "user_id", "left").select(
        "user_id", log_amount(F.coalesce(F.col("_s"), F.lit(0.0))).alias("target_z")
    )


def horizon_exprs(horizons, column: str = "gmv") -> list[Column]:
    return [sum_where(target_window(h), column).alias(f"future_{column}_{h}d") for h in horizons]


def multi_horizon_targets(log: DataFrame, anchors: DataFrame, users: DataFrame | None = None,
                          horizons=(7, 14, 30), column: str = "gmv") -> DataFrame:
    """Sums, log sums and buy flags for several horizons in one pass."""
    sums = aggregate(history(log, anchors, users, back=0, ahead=max(horizons), columns=[column]),
                     horizon_exprs(horizons, column))
    return sums.withColumns({
        **{f"z_target_{h}d": log_amount(f"future_{column}_{h}d") for h in horizons},
        **{f"will_buy_{h}d": flag(F.col(f"future_{column}_{h}d") > 0) for h in horizons},
    })


def first_purchase_interval(log: DataFrame, anchors: DataFrame, users: DataFrame | None = None,
                            edges=(7, 14, 21, 30), column: str = "gmv") -> DataFrame:
    """Number of the interval with the first future purchase, -1 when there is none."""
    sums = aggregate(history(log, anchors, users, back=0, ahead=max(edges), columns=[column]),
                     horizon_exprs(edges, column))
    hit = [F.when(F.col(f"future_{column}_{h}d") > 0, i) for i, h in enumerate(edges)]
    return sums.select(*KEYS, F.coalesce(*hit, F.lit(-1)).alias("hazard_interval"))


def state_exprs(state_days: int, horizon: int, column: str = "gmv") -> list[Column]:
    return [
        sum_where(within(state_days), column).alias(f"past_{column}_{state_days}d"),
        sum_where(target_window(horizon), column).alias(f"future_{column}_{horizon}d"),
    ]


def state_labels(log: DataFrame, anchors: DataFrame, users: DataFrame | None = None, state_days: int = 90,
                 horizon: int = 30, column: str = "gmv") -> DataFrame:
    """Past and future amounts, both activity flags and the log target."""
    hist = history(log, anchors, users, back=state_days, ahead=horizon, columns=[column])
    sums = aggregate(hist, state_exprs(state_days, horizon, column))
    return state_columns(sums, state_days, horizon, column)


def state_columns(sums: DataFrame, state_days: int, horizon: int, column: str = "gmv") -> DataFrame:
    future = F.col(f"future_{column}_{horizon}d")
    return sums.withColumns({
        "was_active": flag(F.col(f"past_{column}_{state_days}d") > 0),
        "will_buy": flag(future > 0),
        "z_target": log_amount(future),
    })


def state_names(state_days: int, horizon: int, column: str = "gmv") -> list[str]:
    return [f"past_{column}_{state_days}d", f"future_{column}_{horizon}d", "was_active", "will_buy", "z_target"]


def transition_state(past_flag: Column, future_flag: Column) -> Column:
    """``00`` stays away, ``01`` comes back, ``10`` leaves, ``11`` stays."""
    return F.concat(past_flag.cast("int").cast("string"), future_flag.cast("int").cast("string"))


def transition_labels(labels: DataFrame, past: str = "was_active", future: str = "will_buy") -> DataFrame:
    """State number 0..3 and the two conditional labels (null outside their population)."""
    p, f = F.col(past).cast("int"), F.col(future).cast("int")
    return labels.withColumns({
        "transition_id": p * 2 + f,
        "transition_state": transition_state(p, f),
        "y_reactivation": F.when(p == 0, f),
        "y_churn": F.when(p == 1, 1 - f),
    })


def specialist_manifest(labels: DataFrame, valid_anchor: str, past: str, future: str, history_days: int = 365,
                        horizon: int = 30) -> DataFrame:
    """Bounds, amounts, flags and state per (anchor, user), with the set it belongs to."""
    a = F.col("anchor_date")
    active, buys = F.col(past) > 0, F.col(future) > 0
    return labels.select(
        "user_id", "anchor_date",
        F.date_sub(a, history_days - 1).alias("history_start"), a.alias("history_end"),
        F.date_add(a, 1).alias("target_start"), F.date_add(a, horizon).alias("target_end"),
        F.col(past).alias("past_amount"), F.col(future).alias("future_amount"),
        log_amount(future).alias("target_z"),
        flag(active).alias("was_active"), flag(buys).alias("will_buy"),
        transition_state(active, buys).alias("transition_state"),
        F.when(a == F.lit(valid_anchor).cast("date"), "validation").otherwise("train").alias("source_anchor_set"),
    )


def specialist_datasets(manifest: DataFrame) -> dict[str, DataFrame]:
    """Training populations of the three specialists."""
    return {
        "reactivation": manifest.where(F.col("was_active") == 0),
        "churn": manifest.where(F.col("was_active") == 1),
        "amount": manifest.where(F.col("future_amount") > 0),
    }


def binary_target(df: DataFrame, target: str = "target", name: str = "will_buy_30d") -> DataFrame:
    return df.withColumn(name, (F.col(target) > 0).cast("int"))
