"""Wide feature snapshots of all anchors in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import flag, log_amount, sum_where
from tidemark.operators import derived
from tidemark.operators.anchors import holiday_table, target_calendar, technical_columns
from tidemark.operators.btyd import RFM_RAW, BgNbd, GammaGamma, btyd_columns, rfm_columns, rfm_exprs
from tidemark.operators.history import KEYS, aggregate, fill, history, target_window
from tidemark.operators.labels import binary_target, state_columns, state_exprs, state_labels, state_names
from tidemark.operators.quality import list_fingerprint
from tidemark.operators.windows import (
    SNAPSHOT_METRICS, SPARSE_METRICS, dynamics_exprs, ewma_exprs, lifetime_exprs, platform_at_anchor, platform_daily,
    sparse_lifetime_exprs, sparse_window_exprs, window_activity_exprs, with_spike_mean,
)

BY_USER = KEYS[::-1]


def snapshot(log: DataFrame, anchors: DataFrame, users: DataFrame | None = None, n_users: float | None = None, history_days: int = 90,
             horizon: int = 30, data_start: str | None = None, with_target: bool = True, state_days: int | None = None) -> DataFrame:
    """Windows, recency, lifetime, dynamics, platform, calendar, rates and segment, with the target.

    Features and target come out of one aggregation. ``history_days`` cuts the
    history, so the lifetime columns cover that many days only. ``n_users`` is the size
    of the platform; by default the users of the index are counted. With ``state_days``, at most ``history_days``,
    the columns of :func:`state_labels` come out of that aggregation, too.
    """
    ahead = horizon if with_target or state_days else 0
    hist = with_spike_mean(history(log, anchors, users, back=history_days, ahead=ahead, columns=SNAPSHOT_METRICS))
    exprs = window_activity_exprs() + lifetime_exprs() + dynamics_exprs()
    if with_target:
        exprs.append(sum_where(target_window(horizon), "gmv").alias("target"))
    if state_days:
        exprs += state_exprs(state_days, horizon)
    platform = platform_at_anchor(platform_daily(log), anchors)
    by_anchor = platform.join(F.broadcast(target_calendar(anchors, holiday_table(anchors), horizon)), "anchor_date")
    size = index_size(log if users is None else users) if n_users is None else n_users

    def finish(raw: DataFrame) -> DataFrame:
        table = fill(raw, recency_names=["customer_age_days"]).join(F.broadcast(by_anchor), "anchor_date")
        table = derived.user_segment(derived.interval_vs_platform(derived.rates_ratios(table), size))
        table = technical_columns(table, history_days, horizon, data_start)
        if state_days:
            table = state_columns(table, state_days, horizon)
        if with_target:
            return binary_target(table)
        return table.withColumns({"target": F.lit(None).cast("double"), "will_buy_30d": F.lit(None).cast("int")})

    return aggregate(hist, exprs, anchors, finish)


def index_size(users: DataFrame) -> Column:
    """The number of users as a scalar subquery."""
    return users.agg(F.count_distinct("user_id")).scalar()


def no_nulls(df: DataFrame) -> DataFrame:
    """Fail inside the job when a feature or a key is null."""
    any_null = F.array_contains(F.array(*[F.col(c).isNull() for c in df.columns]), True)
    checked = F.when(~any_null, F.col("user_id")).otherwise(F.raise_error(F.lit("null feature value")).cast("long"))
    return df.withColumn("user_id", checked)


def sparse_snapshot(log: DataFrame, anchors: DataFrame, users: DataFrame | None = None, model: BgNbd = BgNbd(),
                    money: GammaGamma = GammaGamma(), exact: bool = True, days: int = 180) -> DataFrame:
    """Long windows, full-history recency, decayed sums, behaviour ratios and purchase-model columns.

    The purchase model's window of ``days`` is a part of the history, so its aggregates stand beside the others: no second
    pass over the log, and no wide row is shuffled or sorted for a join.
    """
    hist = history(log, anchors, users, columns=list(SPARSE_METRICS))
    exprs = sparse_window_exprs() + sparse_lifetime_exprs() + ewma_exprs()
    raw = aggregate(hist, exprs + rfm_exprs(days))
    names = [c for c in raw.columns if c not in RFM_RAW]
    rfm = rfm_columns(raw, days, names)
    table = btyd_columns(fill(rfm, recency_names=["customer_age_days"]), model, money, exact=exact)
    btyd = [c for c in table.columns if c not in names]
    table = derived.behaviour_features(table)
    return no_nulls(table.select(*[c for c in table.columns if c not in btyd], *btyd))


def feature_store(log: DataFrame, anchors: DataFrame, users: DataFrame | None = None, state_days: int = 90, horizon: int = 30,
                  order: list[str] | None = None, **options) -> DataFrame:
    """Snapshot features with the state labels, same columns and order for every anchor.

    ``order`` is the feature list of an earlier store, which the new one must have, in its order. Labels within
    the history of the features are aggregated with them; longer ones are joined.
    """
    together = state_days <= options.get("history_days", 90)
    features = snapshot(log, anchors, users, horizon=horizon, with_target=False, state_days=state_days if together else None, **options)
    labels = state_names(state_days, horizon)
    names = [c for c in derived.feature_columns(features) if c not in labels]
    if order is not None and list_fingerprint(names) != list_fingerprint(order):
        raise ValueError(f"the store's features are not those wanted: {sorted(set(names) ^ set(order)) or 'their order differs'}")
    if together:
        # as after a join on the keys, rows without a user have no place in the store
        return features.where("user_id IS NOT NULL").select(*KEYS, *names, *labels)
    return features.select(*KEYS, *names).join(state_labels(log, anchors, users, state_days, horizon), BY_USER).select(*KEYS, *names, *labels)


def check_store(spark: SparkSession, root: str, order: list[str], part: str = "anchor_date") -> DataFrame:
    """Columns of every anchor of a written store against the wanted list: ``(anchor, n_columns, fingerprint, missing, extra, same_order)``.

    Only the schemas of the anchors' folders are read, one per anchor. ``order`` has the columns beside the partition's own.
    """
    rows = []
    for r in spark.read.parquet(root).select(part).distinct().orderBy(part).collect():  # a row per anchor
        names = spark.read.parquet(f"{root.rstrip('/')}/{part}={r[0]}").columns
        rows.append((str(r[0]), len(names), list_fingerprint(names), sorted(set(order) - set(names)), sorted(set(names) - set(order)), int(names == list(order))))
    return spark.createDataFrame(rows, "anchor string, n_columns int, fingerprint string, missing array<string>, extra array<string>, same_order int")


def join_feature_blocks(base: DataFrame, *blocks: DataFrame) -> DataFrame:
    """Several feature blocks of one index in a wide row; column names must not clash.

    All blocks are shuffled by user already, so the join keeps that partitioning
    when the session allows it (``spark.sql.requireAllClusterKeysForCoPartition=false``).
    """
    wide, taken = base, set(base.columns) - set(KEYS)
    for block in blocks:
        clash = taken & (set(block.columns) - set(KEYS))
        if clash:
            raise ValueError(f"column in two blocks: {sorted(clash)}")
        taken |= set(block.columns) - set(KEYS)
        # sorted by user first: few rows share a user, many share an anchor
        wide = wide.join(block, BY_USER, "left")
    return wide.select(*base.columns, *[c for block in blocks for c in block.columns if c not in KEYS])
