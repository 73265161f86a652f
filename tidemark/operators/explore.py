"""Exploration reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import count_where, flag, log_amount
from tidemark.functions.ranking import (
    average_ranks, count_pairs, quantiles, running_totals, spearman, unpivot, value_counts, with_quantiles,
)
from tidemark.operators.metrics import ranking_metrics, squared_log_error

RECENCY_BUCKETS = {"1_0-7": 7, "2_8-14": 14, "3_15-30": 30, "4_31-60": 60, "5_61-90": 90}
CART_BUCKETS = {"1_1-3": 3, "2_4-10": 10}
NAIVE = {
    "last_30d": {"30d": 1.0}, "mean_2": {"30d": 1 / 2, "30_60d": 1 / 2}, "mean_3": {"30d": 1 / 3, "30_60d": 1 / 3, "60_90d": 1 / 3},
    "weighted_3": {"30d": 0.5, "30_60d": 0.3, "60_90d": 0.2},
}


def target_distribution(labels: DataFrame, keys: list[str] = ("anchor_date",), target: str = "target") -> DataFrame:
    y = F.col(target)
    out = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_users"), F.avg(flag(y == 0, "double")).alias("zero_rate"), F.avg(y).alias("mean"), F.sum(y).alias("total"))
    return with_quantiles(out, labels, list(keys), target, {"median": .5, "p90": .9, "p99": .99})


def concentration(labels: DataFrame, keys: list[str] = ("anchor_date",), target: str = "target", shares=(0.001, 0.01, 0.05, 0.1)) -> DataFrame:
    """Part of the total that the top users hold. Users tied at the cut count in part."""
    counts = value_counts(labels, list(keys), target)
    ranked = running_totals(counts, list(keys), target, ["n"])
    above = F.col("n_all") - F.col("n_below") - F.col("n")
    taken = lambda s: F.greatest(F.least(F.col("n"), F.greatest(F.floor(F.col("n_all") * s), F.lit(1)) - above), F.lit(0))
    total = F.sum(F.col(target) * F.col("n"))
    return ranked.groupBy(*keys).agg(*[(F.sum(F.col(target) * taken(s)) / total).alias(f"top_{str(s * 100).rstrip('0').rstrip('.').replace('.', '_')}_pct") for s in shares])


def transition_matrix(labels: DataFrame, keys: list[str], past: Column, future: Column) -> DataFrame:
    per = labels.groupBy(*keys, flag(past).alias("past"), flag(future).alias("future")).agg(F.count(F.lit(1)).alias("n_users"))
    return per.withColumn("share", F.col("n_users") / F.sum("n_users").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))))


def buyer_stability(labels: DataFrame, target: str = "target") -> DataFrame:
    """Users by the number of folds with a purchase."""
    per_user = labels.groupBy("user_id").agg(F.sum(flag(F.col(target) > 0)).alias("n_folds_bought"))
    per = per_user.groupBy("n_folds_bought").agg(F.count(F.lit(1)).alias("n_users"))
    return per.withColumn("share", F.col("n_users") / F.sum("n_users").over(Window.partitionBy(F.lit(0))))  # one row per fold count


def naive_forecasts(features: DataFrame, metric: str = "gmv", shrink: float = 0.8) -> DataFrame:
    """Last month, means of two and three months, weighted mean and shrinkage to the global mean, as columns."""
    col = lambda w: F.col(f"{metric}_sum_{w}")
    means = features.groupBy("anchor_date").agg(F.avg(col("30d")).alias("_mean"))
    out = features.join(F.broadcast(means), "anchor_date")  # one row per anchor
    terms = {name: sum((col(w) * F.lit(k) for w, k in weights.items()), F.lit(0.0)) for name, weights in NAIVE.items()}
    terms["shrunk"] = col("30d") * F.lit(shrink) + F.col("_mean") * F.lit(1 - shrink)
    return out.withColumns({f"naive_{n}": x for n, x in terms.items()}).drop("_mean")


def naive_scores(forecasts: DataFrame, target: str = "target") -> DataFrame:
    names = [c for c in forecasts.columns if c.startswith("naive_")]
    wide = forecasts.groupBy("anchor_date").agg(*[F.sqrt(F.avg(squared_log_error(c, target))).alias(c) for c in names])
    return wide.unpivot(["anchor_date"], names, "forecast", "rmsle")


def bucket_report(df: DataFrame, bucket: Column, keys: list[str] = (), target: str = "target") -> DataFrame:
    """Users, purchase probability, mean and median amount per bucket."""
    y = F.col(target)
    with_bucket = df.withColumn("bucket", bucket)
    out = with_bucket.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n_users"), F.avg(flag(y > 0, "double")).alias("p_buy"), F.avg(y).alias("mean_target"))
    return with_quantiles(out, with_bucket, [*keys, "bucket"], target, {"median_target": .5})


def recency_bucket(c: str = "days_since_last_positive_gmv") -> Column:
    out = None
    for name, top in RECENCY_BUCKETS.items():
        out = F.when(F.col(c) <= top, name) if out is None else out.when(F.col(c) <= top, name)
    return out.otherwise("6_never")


def cart_bucket(c: str = "to_cart_sum_30d") -> Column:
    out = F.when(F.col(c) == 0, "0_none")
    for name, top in CART_BUCKETS.items():
        out = out.when(F.col(c) <= top, name)
    return out.otherwise("3_above_10")


def channel_segment(search: str, catalogue: str) -> Column:
    s, c = F.col(search) > 0, F.col(catalogue) > 0
    return F.when(s & c, "both").when(s, "search_only").when(c, "catalogue_only").otherwise("neither")


def trend_segment(recent: str = "gmv_sum_30d", before: str = "gmv_sum_30_60d") -> Column:
    return F.when(F.col(recent) > F.col(before), "growing").when(F.col(recent) < F.col(before), "falling").otherwise("flat")


def rank_correlation(df: DataFrame, features: list[str], target: str = "target") -> DataFrame:
    """Spearman correlation of each feature with the target; recency counts with the sign turned."""
    long = unpivot(df.withColumn("_y", F.col(target)), ["_y"], features)
    signed = long.withColumn("value", F.when(F.col("feature").startswith("days_since_"), -F.col("value")).otherwise(F.col("value")))
    y_ranks = average_ranks(value_counts(df, [], target).withColumnRenamed(target, "_y"), [], "_y", "_r")
    return spearman(count_pairs(signed, ["feature"], "value", "_y"), ["feature"], "value", "_y", y_ranks).withColumnRenamed("spearman", "spearman_rho")


def pearson_pairs(df: DataFrame, features: list[str], least: float = 0.0) -> DataFrame:
    """Pairs of features with ``|r| >= least``, each over the rows where both are known.

    One aggregate with map-side combine; the result has one row per pair of features.
    """
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    values = df.select(*[F.col(c).cast("double").alias(c) for c in features])
    wide = values.agg(F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.corr(a, b).alias("correlation")) for a, b in pairs]).alias("pairs"))
    return wide.select(F.explode("pairs").alias("p")).select("p.*").where(F.col("correlation").isNotNull() & ~F.isnan("correlation") & (F.abs("correlation") >= least))


def kolmogorov_tail(x: Column, terms: int = 100) -> Column:
    """Asymptotic tail probability of the two-sample statistic."""
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                         lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(F.lit(-2.0) * k * k * x * x))
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(F.lit(2.0) * series, F.lit(0.0)), F.lit(1.0)))


def ks_drift(base: DataFrame, other: DataFrame, features: list[str]) -> DataFrame:
    """Two-sample KS statistic, p-value, means and zero rates of every feature."""
    long = unpivot(base, [], features).withColumn("_s", F.lit(0)).unionByName(unpivot(other, [], features).withColumn("_s", F.lit(1)))
    side = lambda k: flag(F.col("_s") == k, "long")
    counts = value_counts(long, ["feature"], "value", n0=side(0), n1=side(1))
    c = running_totals(counts, ["feature"], "value", ["n0", "n1"])
    upto = lambda k: (F.col(f"n{k}_below") + F.col(f"n{k}")) / F.col(f"n{k}_all")
    mean = lambda k: F.sum(F.col("value") * F.col(f"n{k}")) / F.max(f"n{k}_all")
    zero = lambda k: F.sum(F.when(F.col("value") == 0, F.col(f"n{k}")).otherwise(0)) / F.max(f"n{k}_all")
    out = c.groupBy("feature").agg(
        F.max(F.abs(upto(0) - upto(1))).alias("ks_statistic"), F.max("n0_all").alias("_n0"), F.max("n1_all").alias("_n1"),
        mean(0).alias("base_mean"), mean(1).alias("other_mean"), zero(0).alias("base_zero_rate"), zero(1).alias("other_zero_rate"))
    size = F.sqrt(F.col("_n0") * F.col("_n1") / (F.col("_n0") + F.col("_n1")))
    return out.withColumn("p_value", kolmogorov_tail(size * F.col("ks_statistic"))).drop("_n0", "_n1")


def psi_drift(base: DataFrame, other: DataFrame, features: list[str], bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """Population stability index over quantile bins of the base side."""
    lb, lo = unpivot(base, [], features), unpivot(other, [], features)
    cuts = quantiles(lb, ["feature"], "value", {f"q{i}": i / bins for i in range(1, bins)})
    edges = F.broadcast(cuts.select("feature", F.array_sort(F.array_distinct(F.array(*[f"q{i}" for i in range(1, bins)]))).alias("_edges")))
    binned = lambda d, name: d.join(edges, "feature").withColumn("bin", F.size(F.filter("_edges", lambda e: e < F.col("value")))).groupBy("feature", "bin").agg(
        F.count(F.lit(1)).alias(name))
    both = binned(lb, "p").join(binned(lo, "q"), ["feature", "bin"], "full")
    whole = Window.partitionBy("feature")  # at most ``bins`` rows
    share = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)) / F.sum(F.coalesce(F.col(c), F.lit(0))).over(whole), F.lit(eps))
    shares = both.select("feature", share("p").alias("p"), share("q").alias("q"))
    return shares.groupBy("feature").agg(F.sum((F.col("p") - F.col("q")) * F.log(F.col("p") / F.col("q"))).alias("psi"))


def seasonal_uplift(labels: DataFrame, base_anchor: Column, target: str = "target") -> DataFrame:
    """Total, buyer rate and buyer median of each anchor's window, as an index of the base window."""
    y = F.col(target)
    per = labels.groupBy("anchor_date").agg(F.sum(y).alias("total"), F.avg(y).alias("mean"), F.avg(flag(y > 0, "double")).alias("buyer_rate"))
    per = with_quantiles(per, labels.where(y > 0), ["anchor_date"], target, {"buyer_median": .5})
    base = per.where(F.col("anchor_date") == base_anchor).select(F.col("total").alias("_t"), F.col("buyer_rate").alias("_b"))
    return per.crossJoin(F.broadcast(base)).withColumns({
        "index_total": F.col("total") / (F.col("_t") + F.lit(1e-5)), "index_buyers": F.col("buyer_rate") / (F.col("_b") + F.lit(1e-5)),
    }).drop("_t", "_b")


def platform_baselines(daily: DataFrame, metrics: list[str], window: int = 28, season: int = 7) -> DataFrame:
    """MAPE of a moving average and of the value one season ago, on a daily series (one row per day)."""
    long = unpivot(daily, ["event_date"], metrics, "metric", "value")
    order = Window.partitionBy("metric").orderBy("event_date")
    rows = long.withColumns({
        "_ma": F.when(F.count("value").over(order.rowsBetween(-window, -1)) == window, F.avg("value").over(order.rowsBetween(-window, -1))),
        "_sn": F.lag("value", season).over(order),
    })
    error = lambda c: F.avg(F.when(F.col("value") != 0, F.abs(F.col(c) - F.col("value")) / F.abs("value")))
    return rows.groupBy("metric").agg(F.avg("value").alias("mean_value"), error("_ma").alias("ma_mape"), error("_sn").alias("seasonal_naive_mape"))


def feature_auc(df: DataFrame, features: list[str], target: str = "target") -> DataFrame:
    """ROC-AUC of each single feature for ``target > 0``; recency counts with the sign turned."""
    long = unpivot(df.withColumn("_y", flag(F.col(target) > 0)), ["_y"], features)
    signed = long.withColumn("value", F.when(F.col("feature").startswith("days_since_"), -F.col("value")).otherwise(F.col("value")))
    return ranking_metrics(signed, ["feature"], "value", "_y").select("feature", "roc_auc")
