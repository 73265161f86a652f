"""Forecast and classifier metrics, error decompositions and paired comparisons.

Every function reports per group of ``keys`` (an empty list gives one row). Ranking
metrics work on counts of equal scores, see :mod:`tidemark.functions.ranking`.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import clip, count_where, flag, log_amount, logit
from tidemark.functions.ranking import count_pairs, quantiles, running_totals, spearman, value_counts, with_quantiles

# Lower bounds of the spending tiers and the frequency groups.
TIER_BOUNDS = [50, 250, 1000, 3000]
FREQUENCY_GROUPS = {"1_order": (0, 0), "2_orders": (1, 1), "3-5_orders": (2, 4), "6+_orders": (5, None)}


def squared_log_error(prediction: str = "prediction", target: str = "target") -> Column:
    e = log_amount(prediction) - log_amount(target)
    return e * e


def rmsle(df: DataFrame, keys: list[str], prediction: str = "prediction", target: str = "target") -> DataFrame:
    mse = F.avg(squared_log_error(prediction, target))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), mse.alias("mse_logspace"), F.sqrt(mse).alias("rmsle"))


def prediction_summary(df: DataFrame, keys: list[str], prediction: str = "prediction") -> DataFrame:
    p = F.col(prediction)
    summary = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean"), F.min(p).alias("min"), F.max(p).alias("max"),
                                    F.avg(flag(p == 0, "double")).alias("zero_rate"))
    return with_quantiles(summary, df, keys, prediction, {"median": 0.5})


def score_counts(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Counts per score with the positives among them, and the totals below each score."""
    counts = value_counts(df, keys, score, pos=F.col(label).cast("long"))
    return running_totals(counts, keys, score, ["n", "pos"])


def ranking_metrics(df: DataFrame, keys: list[str], score: str = "p", label: str = "will_buy") -> DataFrame:
    """ROC-AUC (ties count half), average precision and area under the PR curve by trapezoids."""
    c = score_counts(df, keys, score, label)
    neg, neg_below = F.col("n") - F.col("pos"), F.col("n_below") - F.col("pos_below")
    tp, picked = F.col("pos_all") - F.col("pos_below"), F.col("n_all") - F.col("n_below")
    tp_before, picked_before = tp - F.col("pos"), picked - F.col("n")
    precision = tp / picked
    precision_before = F.when(picked_before == 0, F.lit(1.0)).otherwise(tp_before / F.greatest(picked_before, F.lit(1)))
    n_pos, n_neg = F.max("pos_all"), F.max(F.col("n_all") - F.col("pos_all"))
    out = c.groupBy(*keys).agg(
        F.sum(F.col("pos") * (neg_below + neg / 2)).alias("_pairs"), F.sum(F.col("pos") * precision).alias("_ap"),
        F.sum(F.col("pos") * (precision + precision_before) / 2).alias("_trapezoid"),
        n_pos.alias("_p"), n_neg.alias("_n"),
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    rate = F.col("_p") / (F.col("_p") + F.col("_n"))
    per_pos = lambda x: F.when(both, F.col(x) / F.col("_p")).otherwise(rate)
    return out.select(
        *keys, F.when(both, F.col("_pairs") / (F.col("_p") * F.col("_n"))).otherwise(0.5).alias("roc_auc"),
        per_pos("_ap").alias("average_precision"), per_pos("_trapezoid").alias("pr_auc_trapezoid"),
    )


def probability_losses(df: DataFrame, keys: list[str], score: str = "p", label: str = "will_buy", eps: float = 1e-6) -> DataFrame:
    """Clipped log loss and Brier score, and the same for a constant forecast."""
    p, y = clip(score, eps, 1 - eps), F.col(label).cast("double")
    base = F.avg(y)
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), base.alias("base_rate"),
        (-F.avg(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))).alias("log_loss"),
        F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"),
    )
    b = F.col("base_rate")
    return out.withColumns({
        "null_log_loss": -(b * F.log(b + F.lit(eps)) + (F.lit(1.0) - b) * F.log(F.lit(1.0) - b + F.lit(eps))),
        "null_brier": b * (F.lit(1.0) - b),
    })


def calibration_bins(df: DataFrame, keys: list[str], score: str = "p", label: str = "will_buy", bins: int = 10) -> DataFrame:
    """Equal-width bins; a score of exactly 1 belongs to the last one."""
    which = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.withColumn("bin", which).groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate")
    )


def calibration_error(df: DataFrame, keys: list[str], score: str = "p", label: str = "will_buy", bins: int = 10) -> DataFrame:
    b = calibration_bins(df, keys, score, label, bins)
    gap = F.abs(F.col("rate") - F.col("mean_score")) * F.col("n")
    return b.groupBy(*keys).agg((F.sum(gap) / F.sum("n")).alias("expected_calibration_error"))


def decile_lift(df: DataFrame, keys: list[str], score: str = "p", label: str = "will_buy") -> DataFrame:
    """Positive rate at or above the 90 % quantile of the score against the base rate."""
    c = score_counts(df, keys, score, label)
    cut = quantiles(df, keys, score, {"_cut": 0.9})
    joined = c.join(F.broadcast(cut), keys) if keys else c.crossJoin(F.broadcast(cut))  # one row per report group
    top = F.col(score) >= F.col("_cut")
    out = joined.groupBy(*keys).agg(
        (F.sum("pos") / F.sum("n")).alias("base_rate"),
        (F.sum(F.when(top, F.col("pos"))) / F.sum(F.when(top, F.col("n")))).alias("top_rate"),
    )
    return out.withColumn("lift", F.col("top_rate") / (F.col("base_rate") + F.lit(1e-8)))


def confusion_by_threshold(df: DataFrame, keys: list[str], score: str = "p", label: str = "will_buy",
                           thresholds=(0.1, 0.2, 0.3, 0.5)) -> DataFrame:
    """Counts are taken in one pass and turned to rows afterwards."""
    y, p = F.col(label) == 1, F.col(score)
    cells = {"tn": lambda t: ~y & (p < t), "fp": lambda t: ~y & (p >= t), "fn": lambda t: y & (p < t), "tp": lambda t: y & (p >= t)}
    wide = df.groupBy(*keys).agg(*[count_where(cond(t)).alias(f"{name}_{i}") for i, t in enumerate(thresholds) for name, cond in cells.items()])
    entry = lambda i, t: F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{n}_{i}").alias(n) for n in cells])
    return wide.select(*keys, F.inline(F.array(*[entry(i, t) for i, t in enumerate(thresholds)])))


def error_by_transition(df: DataFrame, keys: list[str], state: str = "transition_state", prediction: str = "prediction",
                        target: str = "target") -> DataFrame:
    """Size, error, share of the total error and means of every transition state."""
    sle, zt, zp = squared_log_error(prediction, target), log_amount(target), log_amount(prediction)
    per_state = df.groupBy(*keys, state).agg(
        F.count(F.lit(1)).alias("n"), F.sum(sle).alias("sse"), F.avg(sle).alias("mse"), F.sqrt(F.avg(sle)).alias("rmsle"),
        F.avg(zt).alias("mean_z_true"), F.avg(zp).alias("mean_z_pred"), F.avg(target).alias("mean_target"), F.avg(prediction).alias("mean_prediction"),
        F.sum(F.when(F.col(target) == 0, F.lit(0.0)).otherwise(sle)).alias("oracle_sse"),
    )
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # four rows per group
    total = F.sum("sse").over(whole)
    return per_state.withColumns({
        "share_users": F.col("n") / F.sum("n").over(whole),
        "share_sse": F.when(total > 0, F.col("sse") / total).otherwise(0.0),
        "total_mse": total / F.sum("n").over(whole),
        "oracle_future_zero_mse": F.sum("oracle_sse").over(whole) / F.sum("n").over(whole),
    }).drop("oracle_sse")


def component_report(df: DataFrame, keys: list[str], p_react: str, p_churn: str, amount_z: str) -> DataFrame:
    """Reports of the three parts: return of inactive, leaving of active users, amount of buyers."""
    losses = lambda part, p: probability_losses(part, keys, p, "_y").select(
        *keys, "n", "base_rate", F.col("log_loss").alias("loss"), "brier")
    inactive = df.where("was_active = 0").withColumn("_y", F.col("will_buy"))
    active = df.where("was_active = 1").withColumn("_y", 1 - F.col("will_buy"))
    buyers = df.where("will_buy = 1")
    e = F.col(amount_z) - log_amount("target")
    amount = buyers.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.lit(1.0).alias("base_rate"), F.avg(e * e).alias("loss"), F.lit(None).cast("double").alias("brier"))
    name = lambda d, n: d.withColumn("component", F.lit(n))
    return name(losses(inactive, p_react), "react").unionByName(name(losses(active, p_churn), "churn")).unionByName(name(amount, "amount"))


def report_invariants(df: DataFrame, prediction: str = "prediction", target: str = "target", state: str = "transition_state") -> DataFrame:
    """Absolute violations of the identities a report must satisfy; all about zero."""
    parts = error_by_transition(df, [], state, prediction, target)
    whole = df.agg(F.count(F.lit(1)).alias("_n"), F.avg(squared_log_error(prediction, target)).alias("_mse"),
                   F.avg(flag(F.col(target) > 0, "double")).alias("_rate"))
    folded = parts.agg(
        F.sum("n").alias("_sn"), F.sum(F.col("share_users") * F.col("mse")).alias("_smse"), F.sum("share_users").alias("_sshare"),
        F.sum("share_sse").alias("_ssse"), F.sum(F.when(F.substring(state, 2, 1) == "1", F.col("n")).otherwise(0)).alias("_buyers"),
    )
    one = whole.crossJoin(F.broadcast(folded))
    return one.select(
        F.abs(F.pow(F.sqrt("_mse"), 2) - F.col("_mse")).alias("rmsle_squared_is_mse"),
        F.abs(F.col("_sn") - F.col("_n")).alias("states_cover_all_rows"),
        F.abs(F.col("_smse") - F.col("_mse")).alias("weighted_mse_is_mse"),
        F.abs(F.col("_sshare") - 1).alias("shares_sum_to_one"),
        F.abs(F.col("_ssse") - 1).alias("error_shares_sum_to_one"),
        F.abs(F.col("_buyers") / F.col("_n") - F.col("_rate")).alias("buy_rate_from_states"),
    )


def weighted_delta_by_state(df: DataFrame, base: str, candidate: str, target: str = "target", state: str = "transition_state") -> DataFrame:
    """What each state adds to the MSE reduction of ``candidate`` over ``base``."""
    per = df.groupBy(state).agg(F.count(F.lit(1)).alias("n"), F.avg(squared_log_error(base, target)).alias("mse_baseline"),
                                F.avg(squared_log_error(candidate, target)).alias("mse_candidate"))
    whole = Window.partitionBy(F.lit(0))  # four rows
    gain = F.col("n") / F.sum("n").over(whole) * (F.col("mse_baseline") - F.col("mse_candidate"))
    out = per.withColumns({"delta_mse": F.col("mse_candidate") - F.col("mse_baseline"), "weighted_mse_reduction": gain})
    total = F.sum("weighted_mse_reduction").over(whole)
    return out.withColumn("contribution_share", F.when(F.abs(total) > 1e-12, F.col("weighted_mse_reduction") / total).otherwise(0.0))


#: where the distribution function of Poisson(1) steps, as far as 32 bits can tell it from 1
POISSON_STEPS = [c for c in itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(20)) if c < 1 - 2.0 ** -33]


def poisson_one(u: Column) -> Column:
    """Poisson(1) draw from a uniform number of 32 bits, by its distribution function."""
    return sum((F.when(u >= step, 1).otherwise(0) for step in POISSON_STEPS), F.lit(0))


def paired_bootstrap(df: DataFrame, base: str, candidate: str, target: str = "target", repeats: int = 300, seed: int = 42, blocks: int | None = None) -> DataFrame:
    """Confidence interval of the MSE and RMSLE difference.

    Rows are summed per user, and each repeat draws a Poisson weight per user from a hash of the user: eight draws
    per digest. Weighted sums combine before the shuffle, so only a row per repeat and task moves. With ``blocks`` users
    share their weight with all others of one of so many blocks of a hash, which is coarser and cheaper.
    """
    user = F.col("user_id").cast("string")
    unit = user if blocks is None else F.pmod(F.conv(F.substring(F.sha2(user, 256), 1, 12), 16, 10).cast("long"), F.lit(blocks)).cast("string")
    units = df.groupBy(unit.alias("_unit")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(squared_log_error(base, target)).alias("a"), F.sum(squared_log_error(candidate, target)).alias("b")
    )
    spread = units.select("_unit", "n", "a", "b", F.explode(F.sequence(F.lit(0), F.lit((repeats - 1) // 8))).alias("_chunk"))
    spread = spread.withColumn("_digest", F.sha2(F.concat_ws("|", F.lit(seed), F.col("_chunk").cast("string"), F.col("_unit")), 256))
    eight = F.inline(F.array(*[F.struct((F.col("_chunk") * 8 + j + 1).alias("repeat"), F.conv(F.substring("_digest", 8 * j + 1, 8), 16, 10).cast("double").alias("_u")) for j in range(8)]))
    w = poisson_one(F.col("_u") / F.lit(float(1 << 32)))
    draws = spread.select("n", "a", "b", eight).where(F.col("repeat") <= repeats).withColumn("w", w).where("w > 0").groupBy("repeat").agg(
        (F.sum(F.col("w") * F.col("a")) / F.sum(F.col("w") * F.col("n"))).alias("mse_a"),
        (F.sum(F.col("w") * F.col("b")) / F.sum(F.col("w") * F.col("n"))).alias("mse_b"),
    )
    delta, dr = F.col("mse_b") - F.col("mse_a"), F.sqrt("mse_b") - F.sqrt("mse_a")
    # exact percentiles over the repeats only
    at = lambda c, q: F.percentile(c, F.lit(q))
    sampled = draws.agg(
        at(delta, .025).alias("mse_ci_low"), at(delta, .975).alias("mse_ci_high"), at(dr, .025).alias("rmsle_ci_low"),
        at(dr, .5).alias("rmsle_ci_median"), at(dr, .975).alias("rmsle_ci_high"), F.avg(flag(delta < 0, "double")).alias("p_candidate_better"),
    )
    seen = units.agg(
        F.sum("n").alias("n"), ((F.sum("b") - F.sum("a")) / F.sum("n")).alias("delta_mse"),
        (F.sqrt(F.sum("b") / F.sum("n")) - F.sqrt(F.sum("a") / F.sum("n"))).alias("delta_rmsle"),
    )
    return seen.crossJoin(F.broadcast(sampled))


def spending_tier(target: str = "target") -> Column:
    y = F.col(target)
    tier = F.when(y == 0, "0_zero")
    for i, bound in enumerate(TIER_BOUNDS, 1):
        tier = tier.when(y < bound, f"{i}_below_{bound}")
    return tier.otherwise(f"{len(TIER_BOUNDS) + 1}_from_{TIER_BOUNDS[-1]}")


def error_tiers(df: DataFrame, prediction: str = "prediction", target: str = "target", scale: float = 1.0) -> DataFrame:
    """Errors by size of the true amount (``scale`` divides the amount before the tiers are cut)."""
    sle = squared_log_error(prediction, target)
    per = df.withColumn("_scaled", F.col(target) / F.lit(scale)).groupBy(spending_tier("_scaled").alias("tier")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean_target"), F.avg(prediction).alias("mean_prediction"),
        F.avg(F.abs(F.col(prediction) - F.col(target))).alias("mae"), F.sqrt(F.avg(sle)).alias("rmsle"), F.sum(sle).alias("sse"),
    )
    whole = Window.partitionBy(F.lit(0))  # six rows
    return per.withColumns({"share_users": F.col("n") / F.sum("n").over(whole), "share_sse": F.col("sse") / F.sum("sse").over(whole)})


def zero_split_errors(df: DataFrame, keys: list[str], prediction: str = "prediction", target: str = "target") -> DataFrame:
    """Error on zero and on positive targets, and the prediction on zeros."""
    sle, zero = squared_log_error(prediction, target), F.col(target) == 0
    out = df.groupBy(*keys).agg(
        F.avg(flag(zero, "double")).alias("zero_share"), F.sqrt(F.avg(sle)).alias("rmsle"),
        F.sqrt(F.avg(F.when(zero, sle))).alias("rmsle_on_zero"), F.sqrt(F.avg(F.when(~zero, sle))).alias("rmsle_on_positive"),
        F.avg(F.when(zero, F.col(prediction))).alias("mean_prediction_on_zero"),
        (F.sum(F.when(zero, sle).otherwise(0.0)) / F.sum(sle)).alias("share_sse_on_zero"),
    )
    return with_quantiles(out, df.where(zero), keys, prediction, {"median_prediction_on_zero": 0.5})


def reliability_deciles(df: DataFrame, score: str = "p", label: str = "will_buy", prediction: str = "prediction", target: str = "target") -> DataFrame:
    """Ten bins of about equal size by score rank; equal scores stay in one bin."""
    counts = value_counts(df, [], score, pos=F.col(label).cast("long"), amount=F.col(target), predicted=F.col(prediction),
                          sse=squared_log_error(prediction, target), zeros=flag(F.col(target) == 0, "long"))
    binned = running_totals(counts, [], score, ["n"]).withColumn("decile", F.floor(F.col("n_below") * 10 / F.col("n_all")).cast("int") + 1)
    mean = lambda c: F.sum(c) / F.sum("n")
    return binned.groupBy("decile").agg(
        F.sum("n").alias("n"), F.min(score).alias("min_score"), F.max(score).alias("max_score"),
        mean(F.col(score) * F.col("n")).alias("mean_score"), mean("pos").alias("rate"), mean("predicted").alias("mean_prediction"),
        mean("amount").alias("mean_target"), F.sqrt(mean("sse")).alias("rmsle"), mean("zeros").alias("zero_rate"),
    )


def prediction_correlation(df: DataFrame, names: list[str], target_z: str) -> DataFrame:
    """Correlation of each pair of models and of their errors, in log space."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    err = lambda c: F.col(c) - F.col(target_z)
    wide = df.agg(*[F.corr(F.col(a), F.col(b)).alias(f"p_{i}") for i, (a, b) in enumerate(pairs)],
                  *[F.corr(err(a), err(b)).alias(f"e_{i}") for i, (a, b) in enumerate(pairs)])
    entry = lambda i, a, b: F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(f"p_{i}").alias("prediction_corr"), F.col(f"e_{i}").alias("error_corr"))
    return wide.select(F.inline(F.array(*[entry(i, a, b) for i, (a, b) in enumerate(pairs)])))


def error_overlap(df: DataFrame, base: str, other: str, label: str = "will_buy") -> DataFrame:
    """Share of wrong calls of ``base`` that ``other`` gets right, and the reverse."""
    e = lambda c: F.abs(F.col(label).cast("double") - F.col(c))
    a, b = e(base), e(other)
    return df.agg(F.corr(F.col(base), F.col(other)).alias("score_corr"), F.corr(a, b).alias("error_corr"),
                  F.avg(flag((a > 0.5) & (b < 0.5), "double")).alias("share_fixed"), F.avg(flag((a < 0.5) & (b > 0.5), "double")).alias("share_broken"))


def cv_summary(scores: DataFrame, model: str = "model", fold: str = "fold", score: str = "rmsle") -> DataFrame:
    """Mean, spread, best and worst fold score of each model."""
    return scores.groupBy(model).agg(F.count(F.lit(1)).alias("n_folds"), F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"),
                                     F.min(score).alias("best"), F.max(score).alias("worst"))


def _at_threshold(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    tp, fp, fn, tn = (x.cast("double") for x in (tp, fp, fn, tn))
    safe = lambda a, b: F.when(b > 0, a / F.when(b > 0, b).otherwise(1.0)).otherwise(0.0)
    precision, recall = safe(tp, tp + fp), safe(tp, tp + fn)
    return {
        "accuracy": (tp + tn) / (tp + fp + fn + tn), "precision": precision, "recall": recall,
        "f1": safe(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn),
        "mcc": safe(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
    }


def threshold_metrics(df: DataFrame, score: str = "p", label: str = "will_buy", fixed: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1 and MCC at a fixed threshold and at the one with the best F1."""
    c = score_counts(df, [], score, label)
    tp, picked = F.col("pos_all") - F.col("pos_below"), F.col("n_all") - F.col("n_below")
    f1 = F.lit(2.0) * tp / (picked + F.col("pos_all"))
    cells = F.struct(tp.alias("tp"), (picked - tp).alias("fp"), F.col("pos_below").alias("fn"), (F.col("n_below") - F.col("pos_below")).alias("tn"))
    best = c.agg(F.max_by(F.struct(F.col(score).alias("t"), cells.alias("c")), F.struct(f1.alias("f1"), (-F.col(score)).alias("s"))).alias("b"))
    above = F.col(score) >= fixed
    sums = lambda cond, x: F.coalesce(F.sum(F.when(cond, x)), F.lit(0))
    neg = F.col("n") - F.col("pos")
    at_fixed = c.agg(sums(above, F.col("pos")).alias("tp"), sums(above, neg).alias("fp"), sums(~above, F.col("pos")).alias("fn"), sums(~above, neg).alias("tn"))
    rows = at_fixed.select(F.lit("fixed").alias("rule"), F.lit(float(fixed)).alias("threshold"), "tp", "fp", "fn", "tn").unionByName(
        best.select(F.lit("best_f1").alias("rule"), F.col("b.t").alias("threshold"), "b.c.tp", "b.c.fp", "b.c.fn", "b.c.tn"))
    return rows.withColumns(_at_threshold(*(F.col(x) for x in ("tp", "fp", "fn", "tn"))))


def group_calibration(df: DataFrame, frequency: str, means: list[str], label: str = "will_buy", available: str = "btyd_available") -> DataFrame:
    """Mean model outputs against the real buy rate by number of past orders."""
    f = F.col(frequency)
    group = F.when(F.col(available) == 0, "0_orders")
    for name, (lo, hi) in FREQUENCY_GROUPS.items():
        group = group.when((f >= lo) & (f <= hi) if hi is not None else f >= lo, name)
    per = df.groupBy(group.alias("frequency_group")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"mean_{m}") for m in means], F.avg(F.col(label).cast("double")).alias("actual_buy_rate"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # five rows


def count_errors(df: DataFrame, expected: str, actual: str) -> DataFrame:
    """MAE, RMSE and rank correlation of expected counts."""
    e = F.col(expected) - F.col(actual)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")).crossJoin(F.broadcast(spearman(count_pairs(df, [], expected, actual), [], expected, actual)))


def amount_errors(train: DataFrame, valid: DataFrame, expected: str, target: str = "target") -> DataFrame:
    """RMSLE of an expected amount, raw and after a straight line fitted in log space on train rows."""
    x, y = log_amount(expected), log_amount(target)
    fit = train.agg(F.regr_slope(y, x).alias("scale"), F.regr_intercept(y, x).alias("intercept"))
    z = F.greatest(F.col("scale") * x + F.col("intercept"), F.lit(0.0))
    return valid.crossJoin(F.broadcast(fit)).agg(
        F.sqrt(F.avg((x - y) * (x - y))).alias("raw_rmsle"), F.sqrt(F.avg((z - y) * (z - y))).alias("calibrated_rmsle"),
        F.max("scale").alias("scale"), F.max("intercept").alias("intercept"),
    )
