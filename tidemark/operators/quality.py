"""Checks and audits; a check returns counts of violations, not an exception."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import count_where, flag
from tidemark.functions.ranking import unpivot, with_quantiles
from tidemark.sources.activity import AMOUNT_METRICS, COUNT_METRICS, METRICS

ALLOWED_NAN = ("ts_gmv_skewness_90d", "ts_gmv_kurtosis_90d")


def log_audit(log: DataFrame) -> DataFrame:
    """Rows, duplicate keys, nulls, and how often the channel parts add up."""
    per_key = log.groupBy("user_id", "event_date").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(sum((F.col(c).isNull().cast("int") for c in log.columns), F.lit(0))).alias("_nulls"),
        F.sum(flag(F.col("to_ord") == F.col("search_to_ord") + F.col("cat_to_ord"))).alias("_orders"),
        F.sum(flag(F.abs(F.col("gmv") - F.col("gmv_search") - F.col("gmv_cat")) < 0.005)).alias("_amounts"),
    )
    return per_key.agg(
        F.sum("_n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("n_duplicate_rows"),
        F.sum("_nulls").alias("n_nulls"), (F.sum("_orders") / F.sum("_n")).alias("orders_match_rate"), (F.sum("_amounts") / F.sum("_n")).alias("amount_match_rate"),
    )


def logic_rules(columns: list[str]) -> dict[str, Column]:
    """Rule name to the condition of a violation, for the columns a log has."""
    c = F.col
    rules: dict[str, Column] = {}
    for part in ("search_to_cart", "cat_to_cart", "search_to_ord", "cat_to_ord"):
        total = "to_cart" if part.endswith("cart") else "to_ord"
        rules[f"{part}_above_{total}"] = c(part) > c(total)
        if f"has_{part}" in columns:
            rules[f"has_{part}_wrong"] = c(f"has_{part}") != flag(c(part) > 0)
    for part in ("gmv_search", "gmv_cat"):
        rules[f"{part}_above_gmv"] = c(part) > c("gmv") + 0.005
    for m in METRICS:
        rules[f"{m}_negative"] = c(m) < 0
    for m in AMOUNT_METRICS:
        rules[f"{m}_not_finite"] = F.isnan(m) | (F.abs(m) == float("inf"))
    rules["amount_without_order"] = (c("gmv") > 0) & (c("to_ord") == 0)
    return rules


def logic_checks(log: DataFrame) -> DataFrame:
    """One row per rule with the number of violating rows, from one pass."""
    rules = logic_rules(log.columns)
    wide = log.agg(*[count_where(cond).alias(name) for name, cond in rules.items()])
    return wide.unpivot([], list(rules), "rule", "n_violations")


def check_snapshot(snapshot: DataFrame, n_users: int | Column, horizon: int = 30, with_target: bool = True) -> DataFrame:
    """Violations per anchor: missing or duplicate users, bounds, null targets."""
    a = F.col("anchor_date")
    per_user = snapshot.groupBy("anchor_date", "user_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max(flag(F.col("history_end") > a)).alias("_late"),
        F.max(flag((F.col("target_start") != F.date_add(a, 1)) | (F.col("target_end") != F.date_add(a, horizon)))).alias("_bounds"),
        F.max(flag(F.col("target").isNull())).alias("_null"),
    )
    return per_user.groupBy("anchor_date").agg(
        F.count(F.lit(1)).alias("n_users"), (F.lit(n_users) - F.count(F.lit(1))).alias("missing_users"), count_where(F.col("_n") > 1).alias("duplicate_users"),
        F.sum("_late").alias("history_after_anchor"), F.sum("_bounds").alias("wrong_target_bounds"),
        (F.sum("_null") if with_target else F.sum(F.lit(1) - F.col("_null"))).alias("wrong_target_nulls"),
    )


def finite_check(df: DataFrame, columns: list[str], allowed_nan=ALLOWED_NAN) -> DataFrame:
    """Null, NaN and infinite counts per column; ``ok`` is false for any but an allowed NaN."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        aggs += [count_where(x.isNull()).alias(f"n_{i}"), count_where(F.isnan(x)).alias(f"a_{i}"), count_where(F.abs(x) == float("inf")).alias(f"i_{i}")]
    wide = df.agg(*aggs)
    entry = lambda i, c: F.struct(F.lit(c).alias("feature"), F.col(f"n_{i}").alias("n_null"), F.col(f"a_{i}").alias("n_nan"), F.col(f"i_{i}").alias("n_infinite"),
                                  F.lit(c in allowed_nan).alias("_nan_ok"))
    rows = wide.select(F.inline(F.array(*[entry(i, c) for i, c in enumerate(columns)])))
    ok = (F.col("n_null") == 0) & (F.col("n_infinite") == 0) & ((F.col("n_nan") == 0) | F.col("_nan_ok"))
    return rows.withColumn("ok", ok.cast("int")).drop("_nan_ok")


def check_bank(bank: DataFrame, predictions: list[str], target: str = "future_gmv_30d", target_z: str = "z_target") -> DataFrame:
    """Per anchor: users, duplicates, non-finite predictions, negative targets."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    any_bad = F.exists(F.array(*[bad(c) for c in [*predictions, target, target_z]]), lambda x: x)
    per_user = bank.groupBy("anchor_date", "user_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max(flag(any_bad)).alias("_bad"), F.max(flag((F.col(target) < 0) | (F.col(target_z) < 0))).alias("_neg"))
    return per_user.groupBy("anchor_date").agg(
        F.count(F.lit(1)).alias("n_users"), count_where(F.col("_n") > 1).alias("duplicate_users"), F.sum("_bad").alias("not_finite"), F.sum("_neg").alias("negative_targets"))


def check_submission(submission: DataFrame, template: DataFrame, value: str = "predict") -> DataFrame:
    """Missing, extra and duplicate users, non-finite or negative values, one shuffle for both sides."""
    x = F.col(value).cast("double")
    both = submission.select("user_id", x.alias("_v"), F.lit(1).alias("_s"), F.lit(0).alias("_t")).unionByName(
        template.select("user_id", F.lit(None).cast("double").alias("_v"), F.lit(0).alias("_s"), F.lit(1).alias("_t")))
    v = F.col("_v")
    per_user = both.groupBy("user_id").agg(F.sum("_s").alias("s"), F.sum("_t").alias("t"), F.sum(flag((F.col("_s") == 1) & (
        v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))).alias("bad"), F.sum(flag(v < 0)).alias("neg"))
    return per_user.agg(F.sum("s").alias("n_rows"), count_where((F.col("s") == 0) & (F.col("t") > 0)).alias("missing_users"),
                        count_where((F.col("t") == 0)).alias("extra_users"), count_where(F.col("s") > 1).alias("duplicate_users"),
                        F.sum("bad").alias("not_finite"), F.sum("neg").alias("negative"))


def compare_outputs(left: DataFrame, right: DataFrame, value: str = "predict") -> DataFrame:
    """Two outputs by user: matches, differences, direction, correlations."""
    both = left.select("user_id", F.col(value).alias("a")).join(right.select("user_id", F.col(value).alias("b")), "user_id", "full")
    a, b = F.col("a"), F.col("b")
    d = F.abs(b - a)
    out = both.agg(
        F.count(F.lit(1)).alias("n_users"), count_where(a.isNull() | b.isNull()).alias("n_unmatched"), F.max(d).alias("max_abs_diff"), F.avg(d).alias("mean_abs_diff"),
        count_where(d != 0).alias("n_different"), F.avg(flag(b > a, "double")).alias("share_increased"), F.avg(flag(b < a, "double")).alias("share_decreased"),
        F.avg(F.log1p(b) - F.log1p(a)).alias("mean_log_diff"), F.corr(a, b).alias("pearson"), F.corr(F.log1p(a), F.log1p(b)).alias("pearson_log"),
    )
    return with_quantiles(out, both.withColumn("_d", d), [], "_d", {"median_abs_diff": 0.5})


def distribution_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    x = F.col(value)
    share = lambda cond: F.avg(flag(cond, "double"))
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
                                share(x < 1).alias("share_lt_1"), share(x > 100).alias("share_gt_100"), share(x > 1000).alias("share_gt_1000"))
    return with_quantiles(out, df, keys, value, {f"p{q:02d}": q / 100 for q in (1, 10, 50, 90, 95, 99)})


def content_fingerprint(df: DataFrame, keys: list[str], columns: list[str], portable: bool = False) -> DataFrame:
    """Row count and two order-free hashes of the content.

    ``portable`` hashes the text of the columns by SHA-256, 32 bits of it, which other engines repeat where they write numbers alike.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") if portable else F.xxhash64(*columns)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("xor_hash"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("sum_hash"))


def list_fingerprint(names: list[str]) -> str:
    """Hash of a short list in its order, such as the feature names of a store."""
    return sha256("\n".join(names).encode()).hexdigest()


def leakage_scan(df: DataFrame, features: list[str], target: str = "target", limit: float = 0.99) -> DataFrame:
    """Correlation of every feature with ``target > 0``; suspicious above ``limit``."""
    y = flag(F.col(target) > 0, "double")
    wide = df.agg(*[F.corr(F.col(c).cast("double"), y).alias(f"r_{i}") for i, c in enumerate(features)])
    rows = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r_{i}").alias("correlation")) for i, c in enumerate(features)])))
    return rows.withColumn("suspicious", flag(F.abs("correlation") > limit))


def feature_set_difference(a: list[str], b: list[str], spark) -> DataFrame:
    """Names that only one of two feature lists has."""
    rows = [(n, "only_first") for n in sorted(set(a) - set(b))] + [(n, "only_second") for n in sorted(set(b) - set(a))]
    return spark.createDataFrame(rows, "feature string, where string")


def feature_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """Distribution, missing and finite rate of every feature."""
    long = unpivot(df, [], features)
    x = F.col("value")
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    out = long.groupBy("feature").agg(
        F.avg(F.when(good, x)).alias("mean"), F.stddev_pop(F.when(good, x)).alias("std"), F.min(F.when(good, x)).alias("min"), F.max(F.when(good, x)).alias("max"),
        F.avg(flag(x.isNull() | F.isnan(x), "double")).alias("missing_rate"), F.avg(flag(good, "double")).alias("finite_rate"))
    return with_quantiles(out, long.where(good), ["feature"], "value", {f"p{q:02d}": q / 100 for q in (1, 10, 50, 90, 99)})


def state_definition_audit(df: DataFrame, definitions: list[str], future: str = "will_buy") -> DataFrame:
    """2 x 2 counts of past state and future purchase under several definitions of the past state."""
    options = F.array(*[F.struct(F.lit(c).alias("definition"), F.col(c).cast("int").alias("past")) for c in definitions])
    return df.select(F.col(future).cast("int").alias("future"), F.inline(options)).groupBy("definition", "past", "future").agg(F.count(F.lit(1)).alias("n_users"))
