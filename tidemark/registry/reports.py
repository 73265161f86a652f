"""Queries for quality checks, exploration reports and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exprs import log_amount, sum_where
from tidemark.operators import explore as E
from tidemark.operators import metrics as M
from tidemark.operators import quality as V
from tidemark.operators import snapshot as S
from tidemark.operators import windows as W
from tidemark.operators.history import aggregate, fill, history, target_window
from tidemark.operators.index import user_id_index
from tidemark.operators.labels import transition_state
from tidemark.registry.base import (
    CLICKS, CV, HIST, LOG, PER_USER, QUARTER_CTE, ctes, flag_sql, n, query, s, since, span,
)
from tidemark.registry.features import PLATFORM_SQL, TEMPLATE_SQL, template

FEATURES = ["gmv_sum_30d", "gmv_sum_90d", "to_ord_sum_30d", "to_ord_sum_90d", "to_cart_sum_30d", "searches_sum_90d", "days_since_last_order"]
P1, P2 = "gmv_sum_90d / (gmv_sum_90d + 50000)", "to_ord_sum_90d / (to_ord_sum_90d + 2)"


def scored(t, anchors=None):
    """Window sums, target, two naive forecasts with stand-in probabilities, and states."""
    hist = history(t.log, t.quarters if anchors is None else anchors, back=90, ahead=30, columns=W.FOLD_METRICS + ["search_to_ord", "cat_to_ord"])
    base = fill(aggregate(hist, [
        *W.window_agg_exprs(aggs=["sum"]), W.last_seen("to_ord > 0").alias("days_since_last_order"), W.last_seen("gmv > 0").alias("days_since_last_positive_gmv"),
        *[W.named(W.sum_in(m, 90), f"{m}_sum_90d") for m in ("search_to_ord", "cat_to_ord")],
        sum_where(target_window(30), "gmv").alias("target"),
    ]))
    out = E.naive_forecasts(base)
    active, buys = F.col("gmv_sum_90d") > 0, F.col("target") > 0
    return out.withColumns({
        "prediction": F.col("naive_weighted_3"), "prediction2": F.col("naive_last_30d"), "p": F.expr(P1), "p2": F.expr(P2),
        "was_active": active.cast("int"), "will_buy": buys.cast("int"), "transition_state": transition_state(active, buys),
        "z_target": log_amount("target"),
    })


NAIVE_SQL = {
    "last_30d": "gmv_sum_30d", "mean_2": "gmv_sum_30d * (1.0::DOUBLE / 2) + gmv_sum_30_60d * (1.0::DOUBLE / 2)",
    "mean_3": "gmv_sum_30d * (1.0::DOUBLE / 3) + gmv_sum_30_60d * (1.0::DOUBLE / 3) + gmv_sum_60_90d * (1.0::DOUBLE / 3)",
    "weighted_3": "gmv_sum_30d * 0.5 + gmv_sum_30_60d * 0.3 + gmv_sum_60_90d * 0.2", "shrunk": "gmv_sum_30d * 0.8 + mean30 * 0.2",
}
SUMS_SQL = ", ".join(f"{s(m, lo, hi)} AS {m}_sum_{w}" for w, (hi, lo) in W.FOLD_WINDOWS.items() for m in W.FOLD_METRICS)
SCORED_SQL = f"""sc0 AS (SELECT anchor_date, user_id, {SUMS_SQL}, {since('to_ord > 0', 89, '999')} AS days_since_last_order, {since('gmv > 0', 89, '999')} AS days_since_last_positive_gmv,
 {s('search_to_ord', 0, 89)} AS search_to_ord_sum_90d, {s('cat_to_ord', 0, 89)} AS cat_to_ord_sum_90d, {s('gmv', -30, -1)} AS target {PER_USER}),
 sc AS (SELECT *, {', '.join(f'{x} AS naive_{k}' for k, x in NAIVE_SQL.items())}, {NAIVE_SQL['weighted_3']} AS prediction, gmv_sum_30d AS prediction2, {P1} AS p, {P2} AS p2,
 {flag_sql('gmv_sum_90d > 0')} AS was_active, {flag_sql('target > 0')} AS will_buy, {flag_sql('gmv_sum_90d > 0')} || '' || {flag_sql('target > 0')} AS transition_state,
 ln(1 + target) AS z_target, pow(ln(1 + {NAIVE_SQL['weighted_3']}) - ln(1 + target), 2) AS sle, pow(ln(1 + gmv_sum_30d) - ln(1 + target), 2) AS sle2
 FROM (SELECT *, avg(gmv_sum_30d) OVER (PARTITION BY anchor_date) AS mean30 FROM sc0))"""
SC = ctes(LOG, QUARTER_CTE, HIST, SCORED_SQL)
A = ("anchor_date",)
T = ["anchor_date"]

# --- quality --------------------------------------------------------------------------------

query("log_audit", (), ctes(LOG) + """SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_date FROM log)) AS n_duplicate_rows, 0 AS n_nulls,
 avg(CASE WHEN to_ord = search_to_ord + cat_to_ord THEN 1 ELSE 0 END) AS orders_match_rate, avg(CASE WHEN abs(gmv - gmv_search - gmv_cat) < 0.005 THEN 1 ELSE 0 END) AS amount_match_rate FROM log""")(
    lambda t: V.log_audit(t.log))
RULES = {
    **{f"{p}_above_{w}": f"{p} > {w}" for p, w in {"search_to_cart": "to_cart", "cat_to_cart": "to_cart", "search_to_ord": "to_ord", "cat_to_ord": "to_ord"}.items()},
    **{f"{p}_above_gmv": f"{p} > gmv + 0.005" for p in ("gmv_search", "gmv_cat")},
    **{f"{m}_negative": f"{m} < 0" for m in ("searches", "cat", "to_cart", "to_ord", "search_to_cart", "cat_to_cart", "search_to_ord", "cat_to_ord", "gmv", "gmv_search", "gmv_cat")},
    **{f"{m}_not_finite": f"NOT isfinite({m})" for m in ("gmv", "gmv_search", "gmv_cat")}, "amount_without_order": "gmv > 0 AND to_ord = 0",
}
query("logic_checks", ("rule",), ctes(CLICKS) + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE {c}) AS n_violations FROM log" for k, c in RULES.items()))(
    lambda t: V.logic_checks(t.clicks))
query("check_snapshot", A, ctes(LOG, CV) + """SELECT anchor_date, (SELECT count(DISTINCT user_id) FROM log) AS n_users, (SELECT count(*) FROM customer) - (SELECT count(DISTINCT user_id) FROM log) AS missing_users,
 0 AS duplicate_users, 0 AS history_after_anchor, 0 AS wrong_target_bounds, 0 AS wrong_target_nulls FROM a""")(
    lambda t: V.check_snapshot(S.technical_columns(W.aggregate(history(t.log, t.cv, back=30, ahead=30, columns=["gmv"]), [
        sum_where(target_window(30), "gmv").alias("target")])), t.read("customer").agg(F.count(F.lit(1))).scalar()))
query("finite_check", ("feature",), SC + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS n_null, 0 AS n_nan, 0 AS n_infinite, CASE WHEN count(*) FILTER (WHERE {c} IS NULL) = 0 THEN 1 ELSE 0 END AS ok FROM sc" for c in ("gmv_sum_30d", "p", "target")))(
    lambda t: V.finite_check(scored(t), ["gmv_sum_30d", "p", "target"]))
query("check_bank", A, SC + "SELECT anchor_date, count(*) AS n_users, 0 AS duplicate_users, 0 AS not_finite, 0 AS negative_targets FROM sc GROUP BY 1")(
    lambda t: V.check_bank(scored(t), ["p", "prediction"], "target"))
query("check_submission", (), ctes(LOG) + """SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT user_id FROM log)) - count(*) AS missing_users, 0 AS extra_users,
 0 AS duplicate_users, 0 AS not_finite, 0 AS negative FROM (SELECT user_id FROM log GROUP BY user_id HAVING sum(gmv) > 1000000)""")(
    lambda t: V.check_submission(t.log.groupBy("user_id").agg(F.sum("gmv").alias("predict")).where("predict > 1000000"), template(t)))
query("compare_outputs", (), SC + """SELECT count(*) AS n_users, 0 AS n_unmatched, max(abs(b - a)) AS max_abs_diff, avg(abs(b - a)) AS mean_abs_diff, count(*) FILTER (WHERE abs(b - a) > 1e-6) AS n_different,
 avg(CASE WHEN b > a THEN 1 ELSE 0 END) AS share_increased, avg(CASE WHEN b < a THEN 1 ELSE 0 END) AS share_decreased, avg(ln(1 + b) - ln(1 + a)) AS mean_log_diff, corr(a, b) AS pearson,
 corr(ln(1 + a), ln(1 + b)) AS pearson_log, median(abs(b - a)) AS median_abs_diff FROM (SELECT prediction2 AS a, naive_mean_2 AS b FROM sc WHERE anchor_date = DATE '2001-01-01')""")(
    lambda t: (lambda d: V.compare_outputs(d.select("user_id", F.col("prediction2").alias("predict")), d.select("user_id", F.col("naive_mean_2").alias("predict"))))(
        scored(t).where("anchor_date = '2001-01-01'")))
STATS = """count(*) AS n, avg(prediction) AS mean, stddev_pop(prediction) AS std, min(prediction) AS min, max(prediction) AS max, avg(CASE WHEN prediction < 1 THEN 1 ELSE 0 END) AS share_lt_1,
 avg(CASE WHEN prediction > 100 THEN 1 ELSE 0 END) AS share_gt_100, avg(CASE WHEN prediction > 1000 THEN 1 ELSE 0 END) AS share_gt_1000, """ + ", ".join(
    f"quantile_cont(prediction, {q / 100}) AS p{q:02d}" for q in (1, 10, 50, 90, 95, 99))
query("distribution_stats", ("was_active",), SC + f"SELECT was_active, {STATS} FROM sc GROUP BY 1")(lambda t: V.distribution_stats(scored(t), ["was_active"], "prediction"))
query("content_fingerprint", ("anchor_date", "xor_hash", "sum_hash"))(lambda t: V.content_fingerprint(scored(t), T, ["user_id", "target"]))
query("content_fingerprint_portable", A, SC + """, f AS (SELECT anchor_date, CAST('0x' || substr(sha256(user_id || '|' || CAST(to_ord_sum_90d AS BIGINT)), 1, 8) AS BIGINT) AS h FROM sc)
 SELECT anchor_date, count(*) AS n_rows, bit_xor(h) AS xor_hash, sum(h % 2147483648)::BIGINT AS sum_hash FROM f GROUP BY 1""")(
    lambda t: V.content_fingerprint(scored(t).withColumn("n", F.col("to_ord_sum_90d").cast("long")), T, ["user_id", "n"], portable=True))
query("leakage_scan", ("feature",), SC + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, will_buy) AS correlation, CASE WHEN abs(corr({c}, will_buy)) > 0.99 THEN 1 ELSE 0 END AS suspicious FROM sc" for c in [*FEATURES, "z_target", "will_buy"]))(
    lambda t: V.leakage_scan(scored(t), [*FEATURES, "z_target", "will_buy"]))
query("feature_profile", ("feature",), SC + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) AS std, min({c}) AS min, max({c}) AS max, 0 AS missing_rate, 1 AS finite_rate, "
    + ", ".join(f"quantile_cont({c}, {q / 100}) AS p{q:02d}" for q in (1, 10, 50, 90, 99)) + " FROM sc" for c in FEATURES))(
    lambda t: V.feature_profile(scored(t), FEATURES))
query("state_definition_audit", ("definition",), SC + """SELECT definition, past, will_buy AS future, count(*) AS n_users FROM (SELECT will_buy, 'by_amount_90' AS definition, was_active AS past FROM sc
 UNION ALL SELECT will_buy, 'by_amount_30', CASE WHEN gmv_sum_30d > 0 THEN 1 ELSE 0 END FROM sc UNION ALL SELECT will_buy, 'by_cart_30', CASE WHEN to_cart_sum_30d > 0 THEN 1 ELSE 0 END FROM sc) GROUP BY 1, 2, 3""")(
    lambda t: V.state_definition_audit(scored(t).withColumns({"by_amount_90": F.col("was_active"), "by_amount_30": (F.col("gmv_sum_30d") > 0).cast("int"),
                                                              "by_cart_30": (F.col("to_cart_sum_30d") > 0).cast("int")}), ["by_amount_90", "by_amount_30", "by_cart_30"]))

# --- exploration ----------------------------------------------------------------------------

query("target_distribution", A, SC + """SELECT anchor_date, count(*) AS n_users, avg(CASE WHEN target = 0 THEN 1 ELSE 0 END) AS zero_rate, avg(target) AS mean, sum(target) AS total,
 median(target) AS median, quantile_cont(target, .9) AS p90, quantile_cont(target, .99) AS p99 FROM sc GROUP BY 1""")(lambda t: E.target_distribution(scored(t)))
TOP_SQL = ", ".join(f"sum(target) FILTER (WHERE r <= greatest(floor(n * {x}), 1)) / sum(target) AS {k}" for k, x in
                    {"top_0_1_pct": 0.001, "top_1_pct": 0.01, "top_5_pct": 0.05, "top_10_pct": 0.1}.items())
query("concentration", A, SC + f"""SELECT anchor_date, {TOP_SQL} FROM (SELECT anchor_date, target, row_number() OVER (PARTITION BY anchor_date ORDER BY target DESC) AS r,
 count(*) OVER (PARTITION BY anchor_date) AS n FROM sc) GROUP BY 1""")(lambda t: E.concentration(scored(t)))
query("transition_matrix", ("anchor_date", "past", "future"), SC + "SELECT anchor_date, CASE WHEN gmv_sum_30d > 0 THEN 1 ELSE 0 END AS past, will_buy AS future, count(*) AS n_users, count(*) / sum(count(*)) OVER (PARTITION BY anchor_date) AS share FROM sc GROUP BY 1, 2, 3")(
    lambda t: E.transition_matrix(scored(t), T, F.col("gmv_sum_30d") > 0, F.col("target") > 0))
query("buyer_stability", ("n_folds_bought",), SC + "SELECT n_folds_bought, count(*) AS n_users, count(*) / sum(count(*)) OVER () AS share FROM (SELECT user_id, sum(will_buy)::BIGINT AS n_folds_bought FROM sc GROUP BY 1) GROUP BY 1")(
    lambda t: E.buyer_stability(scored(t)))
query("naive_forecasts", ("anchor_date", "user_id"), SC + f"SELECT anchor_date, user_id, {', '.join(f'naive_{k}' for k in NAIVE_SQL)} FROM sc")(
    lambda t: scored(t).select("anchor_date", "user_id", *[f"naive_{k}" for k in NAIVE_SQL]))
query("naive_scores", ("anchor_date", "forecast"), SC + " UNION ALL ".join(
    f"SELECT anchor_date, 'naive_{k}' AS forecast, sqrt(avg(pow(ln(1 + naive_{k}) - ln(1 + target), 2))) AS rmsle FROM sc GROUP BY 1" for k in NAIVE_SQL))(
    lambda t: E.naive_scores(scored(t)))
BUCKET = "count(*) AS n_users, avg(will_buy) AS p_buy, avg(target) AS mean_target, median(target) AS median_target FROM sc GROUP BY 1"
RECENCY_SQL = "CASE " + " ".join(f"WHEN days_since_last_positive_gmv <= {v} THEN '{k}'" for k, v in E.RECENCY_BUCKETS.items()) + " ELSE '6_never' END"
query("recency_bucket_conversion", ("bucket",), SC + f"SELECT {RECENCY_SQL} AS bucket, {BUCKET}")(lambda t: E.bucket_report(scored(t), E.recency_bucket()))
query("cart_bucket_conversion", ("bucket",), SC + f"SELECT CASE WHEN to_cart_sum_30d = 0 THEN '0_none' WHEN to_cart_sum_30d <= 3 THEN '1_1-3' WHEN to_cart_sum_30d <= 10 THEN '2_4-10' ELSE '3_above_10' END AS bucket, {BUCKET}")(
    lambda t: E.bucket_report(scored(t), E.cart_bucket()))
query("channel_segments", ("bucket",), SC + f"SELECT CASE WHEN search_to_ord_sum_90d > 0 AND cat_to_ord_sum_90d > 0 THEN 'both' WHEN search_to_ord_sum_90d > 0 THEN 'search_only' WHEN cat_to_ord_sum_90d > 0 THEN 'catalogue_only' ELSE 'neither' END AS bucket, {BUCKET}")(
    lambda t: E.bucket_report(scored(t), E.channel_segment("search_to_ord_sum_90d", "cat_to_ord_sum_90d")))
query("trend_segments", ("bucket",), SC + f"SELECT CASE WHEN gmv_sum_30d > gmv_sum_30_60d THEN 'growing' WHEN gmv_sum_30d < gmv_sum_30_60d THEN 'falling' ELSE 'flat' END AS bucket, {BUCKET}")(
    lambda t: E.bucket_report(scored(t), E.trend_segment()))


def sign(c: str) -> str:
    return f"-{c}" if c.startswith("days_since_") else c


RANK = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
query("rank_correlation", ("feature",), SC + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr(rx, ry) AS spearman_rho FROM (SELECT {RANK(sign(c))} AS rx, {RANK('target')} AS ry FROM sc)" for c in FEATURES))(
    lambda t: E.rank_correlation(scored(t), FEATURES))
query("pearson_pairs", ("feature_a", "feature_b"), SC + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS correlation FROM sc" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]) + ") WHERE abs(correlation) >= 0.5")(
    lambda t: E.pearson_pairs(scored(t), FEATURES, 0.5))
query("daily_correlation", ("feature_a", "feature_b"), ctes(LOG) + ", d AS (SELECT event_date, sum(gmv) AS gmv_total, sum(to_ord) AS to_ord_total, sum(searches) AS searches_total FROM log GROUP BY 1)"
      + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS correlation FROM d" for a, b in
                           (("gmv_total", "to_ord_total"), ("gmv_total", "searches_total"), ("to_ord_total", "searches_total"))))(
    lambda t: E.pearson_pairs(W.daily_totals(t.log, ["gmv", "to_ord", "searches"]), ["gmv_total", "to_ord_total", "searches_total"]))


def ks_sql(c: str) -> str:
    side = lambda k: f"(SELECT {c} AS v FROM sc WHERE anchor_date = DATE '{k}')"
    return f"""SELECT '{c}' AS feature, max(abs(f0 - f1)) AS d, any_value(n0) AS n0, any_value(n1) AS n1, sum(v * c0) / any_value(n0) AS base_mean, sum(v * c1) / any_value(n1) AS other_mean,
 coalesce(sum(c0) FILTER (WHERE v = 0), 0) / any_value(n0) AS base_zero_rate, coalesce(sum(c1) FILTER (WHERE v = 0), 0) / any_value(n1) AS other_zero_rate FROM (SELECT *, sum(c0) OVER w / sum(c0) OVER () AS f0,
 sum(c1) OVER w / sum(c1) OVER () AS f1, sum(c0) OVER () AS n0, sum(c1) OVER () AS n1 FROM (SELECT v, sum(c0) AS c0, sum(c1) AS c1 FROM (SELECT v, 1 AS c0, 0 AS c1 FROM {side('2000-01-01')} UNION ALL
 SELECT v, 0, 1 FROM {side('2001-04-01')}) GROUP BY v) WINDOW w AS (ORDER BY v))"""


query("ks_drift", ("feature",), SC + ", k AS (" + " UNION ALL ".join(ks_sql(c) for c in FEATURES) + """)
 SELECT feature, d AS ks_statistic, base_mean, other_mean, base_zero_rate, other_zero_rate, CASE WHEN x < 0.2 THEN 1 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101),
 lambda j: CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * j * j * x * x))), 0), 1) END AS p_value FROM (SELECT *, sqrt(n0 * n1 / (n0 + n1)) * d AS x FROM k)""")(
    lambda t: (lambda d: E.ks_drift(d.where("anchor_date = '2000-01-01'"), d.where("anchor_date = '2001-04-01'"), FEATURES))(scored(t)))


def psi_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, sum((p - q) * ln(p / q)) AS psi FROM (SELECT greatest(coalesce(np, 0) / sum(coalesce(np, 0)) OVER (), 1e-4) AS p, greatest(coalesce(nq, 0) / sum(coalesce(nq, 0)) OVER (), 1e-4) AS q FROM
 (SELECT len(list_filter(e, lambda x: x < v)) AS bin, count(*) FILTER (WHERE side = 0) AS np, count(*) FILTER (WHERE side = 1) AS nq FROM
 (SELECT {c} AS v, CASE WHEN anchor_date = DATE '2000-01-01' THEN 0 ELSE 1 END AS side FROM sc WHERE anchor_date IN (DATE '2000-01-01', DATE '2001-04-01')),
 (SELECT list_distinct(quantile_cont({c}, [.1, .2, .3, .4, .5, .6, .7, .8, .9])) AS e FROM sc WHERE anchor_date = DATE '2000-01-01') GROUP BY 1))"""


query("psi_drift", ("feature",), SC + " UNION ALL ".join(psi_sql(c) for c in ("to_ord_sum_90d", "to_cart_sum_30d", "days_since_last_order")))(
    lambda t: (lambda d: E.psi_drift(d.where("anchor_date = '2000-01-01'"), d.where("anchor_date = '2001-04-01'"), ["to_ord_sum_90d", "to_cart_sum_30d", "days_since_last_order"]))(scored(t)))
query("seasonal_uplift", A, SC + """, w AS (SELECT anchor_date, sum(target) AS total, avg(target) AS mean, avg(will_buy) AS buyer_rate, median(target) FILTER (WHERE target > 0) AS buyer_median FROM sc GROUP BY 1)
 SELECT w.*, w.total / (b.total + 1e-5) AS index_total, w.buyer_rate / (b.buyer_rate + 1e-5) AS index_buyers FROM w, (SELECT * FROM w WHERE anchor_date = DATE '2000-04-01') b""")(
    lambda t: E.seasonal_uplift(scored(t), F.lit("2000-04-01").cast("date")))
PLATFORM_METRICS = ["global_dau", "global_gmv_per_active", "global_buyer_rate"]
query("platform_baselines", ("metric",), ctes(LOG, PLATFORM_SQL) + " UNION ALL ".join(f"""SELECT '{m}' AS metric, avg({m}) AS mean_value, avg(abs(ma - {m}) / {m}) AS ma_mape, avg(abs(sn - {m}) / {m}) AS seasonal_naive_mape FROM
 (SELECT {m}, CASE WHEN count(*) OVER w = 28 THEN avg({m}) OVER w END AS ma, lag({m}, 7) OVER (ORDER BY event_date) AS sn FROM p WINDOW w AS (ORDER BY event_date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING))""" for m in PLATFORM_METRICS))(
    lambda t: E.platform_baselines(W.platform_daily(t.log), PLATFORM_METRICS))


def auc_sql(score: str, label: str, source: str) -> str:
    """Rank form of the area under the curve."""
    return f"""SELECT CASE WHEN p * q > 0 THEN (s - p * (p + 1) / 2) / (p * q) ELSE 0.5 END FROM (SELECT sum(r) FILTER (WHERE y = 1) AS s, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS q
 FROM (SELECT {label} AS y, {RANK(score)} AS r FROM {source}))"""


query("feature_auc", ("feature",), SC + " UNION ALL ".join(f"SELECT '{c}' AS feature, ({auc_sql(sign(c), 'will_buy', 'sc')}) AS roc_auc" for c in FEATURES))(
    lambda t: E.feature_auc(scored(t), FEATURES))

# --- metrics --------------------------------------------------------------------------------

query("rmsle", A, SC + "SELECT anchor_date, count(*) AS n, avg(sle) AS mse_logspace, sqrt(avg(sle)) AS rmsle FROM sc GROUP BY 1")(lambda t: M.rmsle(scored(t), T))
query("prediction_summary", A, SC + "SELECT anchor_date, count(*) AS n, avg(prediction) AS mean, min(prediction) AS min, max(prediction) AS max, avg(CASE WHEN prediction = 0 THEN 1 ELSE 0 END) AS zero_rate, median(prediction) AS median FROM sc GROUP BY 1")(
    lambda t: M.prediction_summary(scored(t), T))
CURVE_SQL = """c AS (SELECT p2 AS v, count(*) AS n, sum(will_buy) AS pos FROM sc GROUP BY 1),
 pr AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS picked, sum(pos) OVER () AS np FROM c WINDOW w AS (ORDER BY v DESC)),
 pr2 AS (SELECT *, tp / picked AS prec, lag(tp / picked, 1, 1.0) OVER (ORDER BY v DESC) AS before FROM pr)"""
query("ranking_metrics", (), SC + f", {CURVE_SQL} SELECT ({auc_sql('p2', 'will_buy', 'sc')}) AS roc_auc, (SELECT sum(pos * prec) / any_value(np) FROM pr2) AS average_precision, (SELECT sum(pos * (prec + before) / 2) / any_value(np) FROM pr2) AS pr_auc_trapezoid")(
    lambda t: M.ranking_metrics(scored(t), [], "p2"))
query("roc_auc", (), SC + f"SELECT ({auc_sql('p', 'will_buy', 'sc')}) AS roc_auc")(lambda t: M.ranking_metrics(scored(t), [], "p").select("roc_auc"))
CLIP = "least(greatest(p, 1e-6), 1 - 1e-6)"
query("probability_losses", A, SC + f"""SELECT *, -(base_rate * ln(base_rate + 1e-6) + (1 - base_rate) * ln(1 - base_rate + 1e-6)) AS null_log_loss, base_rate * (1 - base_rate) AS null_brier FROM
 (SELECT anchor_date, count(*) AS n, avg(will_buy) AS base_rate, -avg(will_buy * ln({CLIP}) + (1 - will_buy) * ln(1 - {CLIP})) AS log_loss, avg(pow(p - will_buy, 2)) AS brier FROM sc GROUP BY 1)""")(
    lambda t: M.probability_losses(scored(t), T))
BINS_SQL = "b AS (SELECT least(floor(p2 * 10), 9) AS bin, count(*) AS n, avg(p2) AS mean_score, avg(will_buy) AS rate FROM sc GROUP BY 1)"
query("calibration_bins", ("bin",), SC + f", {BINS_SQL} SELECT CAST(bin AS INT) AS bin, n, mean_score, rate FROM b")(lambda t: M.calibration_bins(scored(t), [], "p2"))
query("calibration_error", (), SC + f", {BINS_SQL} SELECT sum(n * abs(rate - mean_score)) / sum(n) AS expected_calibration_error FROM b")(lambda t: M.calibration_error(scored(t), [], "p2"))
query("decile_lift", A, SC + """SELECT anchor_date, avg(will_buy) AS base_rate, avg(will_buy) FILTER (WHERE p >= cut) AS top_rate, avg(will_buy) FILTER (WHERE p >= cut) / (avg(will_buy) + 1e-8) AS lift
 FROM sc JOIN (SELECT anchor_date, quantile_cont(p, .9) AS cut FROM sc GROUP BY 1) USING (anchor_date) GROUP BY 1""")(lambda t: M.decile_lift(scored(t), T))
query("confusion_by_threshold", ("anchor_date",), SC + """SELECT anchor_date, threshold, count(*) FILTER (WHERE will_buy = 0 AND p < threshold) AS tn, count(*) FILTER (WHERE will_buy = 0 AND p >= threshold) AS fp,
 count(*) FILTER (WHERE will_buy = 1 AND p < threshold) AS fn, count(*) FILTER (WHERE will_buy = 1 AND p >= threshold) AS tp FROM sc, (VALUES (0.1::DOUBLE), (0.2), (0.3), (0.5)) AS v(threshold) GROUP BY 1, 2""")(
    lambda t: M.confusion_by_threshold(scored(t), T))
STATE_SQL = """SELECT anchor_date, transition_state, count(*) AS n, sum(sle) AS sse, avg(sle) AS mse, sqrt(avg(sle)) AS rmsle, avg(z_target) AS mean_z_true, avg(ln(1 + prediction)) AS mean_z_pred,
 avg(target) AS mean_target, avg(prediction) AS mean_prediction, count(*) / sum(count(*)) OVER w AS share_users, sum(sle) / sum(sum(sle)) OVER w AS share_sse, sum(sum(sle)) OVER w / sum(count(*)) OVER w AS total_mse,
 sum(sum(CASE WHEN target = 0 THEN 0 ELSE sle END)) OVER w / sum(count(*)) OVER w AS oracle_future_zero_mse FROM sc GROUP BY 1, 2 WINDOW w AS (PARTITION BY anchor_date)"""
query("error_by_transition", ("anchor_date", "transition_state"), SC + STATE_SQL)(lambda t: M.error_by_transition(scored(t), T))
PART = lambda name, cond, y, p: f"SELECT '{name}' AS component, count(*) AS n, avg({y}) AS base_rate, -avg({y} * ln(least(greatest({p}, 1e-6), 1 - 1e-6)) + (1 - {y}) * ln(1 - least(greatest({p}, 1e-6), 1 - 1e-6))) AS loss, avg(pow({p} - {y}, 2)) AS brier FROM sc WHERE {cond}"
query("component_report", ("component",), SC + PART("react", "was_active = 0", "will_buy", "p") + " UNION ALL " + PART("churn", "was_active = 1", "(1 - will_buy)", "p2")
      + " UNION ALL SELECT 'amount', count(*), 1, avg(pow(ln(1 + prediction) - z_target, 2)), NULL FROM sc WHERE will_buy = 1")(
    lambda t: M.component_report(scored(t).withColumn("_az", log_amount("prediction")), [], "p", "p2", "_az"))
query("report_invariants", (), "SELECT 0 AS rmsle_squared_is_mse, 0 AS states_cover_all_rows, 0 AS weighted_mse_is_mse, 0 AS shares_sum_to_one, 0 AS error_shares_sum_to_one, 0 AS buy_rate_from_states FROM (SELECT count(*) FROM orders)")(
    lambda t: M.report_invariants(scored(t)))
query("weighted_delta_by_state", ("transition_state",), SC + """SELECT *, weighted_mse_reduction / sum(weighted_mse_reduction) OVER () AS contribution_share FROM (SELECT transition_state, count(*) AS n, avg(sle2) AS mse_baseline,
 avg(sle) AS mse_candidate, avg(sle) - avg(sle2) AS delta_mse, count(*) / sum(count(*)) OVER () * (avg(sle2) - avg(sle)) AS weighted_mse_reduction FROM sc GROUP BY 1)""")(
    lambda t: M.weighted_delta_by_state(scored(t), "prediction2", "prediction"))


U = "CAST(CAST('0x' || substr(sha256('42|' || ((rep - 1) // 8) || '|' || user_id), 8 * ((rep - 1) % 8) + 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296"
query("paired_bootstrap", (), SC + f""", b AS (SELECT user_id, count(*) AS n, sum(sle2) AS a, sum(sle) AS b FROM sc GROUP BY 1),
 d AS (SELECT rep, sum(w * a) / sum(w * n) AS ma, sum(w * b) / sum(w * n) AS mb FROM (SELECT *, {' + '.join(f'CASE WHEN u >= {c!r} THEN 1 ELSE 0 END' for c in M.POISSON_STEPS)} AS w FROM (SELECT *, {U} AS u FROM b, range(1, 301) AS r(rep))) GROUP BY 1)
 SELECT * FROM (SELECT sum(n) AS n, (sum(b) - sum(a)) / sum(n) AS delta_mse, sqrt(sum(b) / sum(n)) - sqrt(sum(a) / sum(n)) AS delta_rmsle FROM b),
 (SELECT quantile_cont(mb - ma, .025) AS mse_ci_low, quantile_cont(mb - ma, .975) AS mse_ci_high, quantile_cont(sqrt(mb) - sqrt(ma), .025) AS rmsle_ci_low, quantile_cont(sqrt(mb) - sqrt(ma), .5) AS rmsle_ci_median,
  quantile_cont(sqrt(mb) - sqrt(ma), .975) AS rmsle_ci_high, avg(CASE WHEN mb < ma THEN 1 ELSE 0 END) AS p_candidate_better FROM d)""")(
    lambda t: M.paired_bootstrap(scored(t), "prediction2", "prediction"))
query("error_tiers", ("tier",), SC + """SELECT tier, n, mean_target, mean_prediction, mae, rmsle, sse, n / sum(n) OVER () AS share_users, sse / sum(sse) OVER () AS share_sse FROM (SELECT CASE WHEN target = 0 THEN '0_zero'
 WHEN target / 500 < 50 THEN '1_below_50' WHEN target / 500 < 250 THEN '2_below_250' WHEN target / 500 < 1000 THEN '3_below_1000' WHEN target / 500 < 3000 THEN '4_below_3000' ELSE '5_from_3000' END AS tier, count(*) AS n,
 avg(target) AS mean_target, avg(prediction) AS mean_prediction, avg(abs(prediction - target)) AS mae, sqrt(avg(sle)) AS rmsle, sum(sle) AS sse FROM sc GROUP BY 1)""")(
    lambda t: M.error_tiers(scored(t), scale=500.0))
query("zero_split_errors", A, SC + """SELECT anchor_date, avg(CASE WHEN target = 0 THEN 1 ELSE 0 END) AS zero_share, sqrt(avg(sle)) AS rmsle, sqrt(avg(sle) FILTER (WHERE target = 0)) AS rmsle_on_zero, sqrt(avg(sle) FILTER (WHERE target > 0)) AS rmsle_on_positive,
 avg(prediction) FILTER (WHERE target = 0) AS mean_prediction_on_zero, sum(sle) FILTER (WHERE target = 0) / sum(sle) AS share_sse_on_zero, median(prediction) FILTER (WHERE target = 0) AS median_prediction_on_zero FROM sc GROUP BY 1""")(
    lambda t: M.zero_split_errors(scored(t), T))
query("reliability_deciles", ("decile",), SC + """SELECT CAST(decile AS INT) AS decile, count(*) AS n, min(p) AS min_score, max(p) AS max_score, avg(p) AS mean_score, avg(will_buy) AS rate, avg(prediction) AS mean_prediction, avg(target) AS mean_target,
 sqrt(avg(sle)) AS rmsle, avg(CASE WHEN target = 0 THEN 1 ELSE 0 END) AS zero_rate FROM (SELECT *, 1 + floor((rank() OVER (ORDER BY p) - 1) * 10 / count(*) OVER ()) AS decile FROM sc) GROUP BY 1""")(
    lambda t: M.reliability_deciles(scored(t)))
Z3 = {"z_a": "ln(1 + prediction)", "z_b": "ln(1 + prediction2)", "z_c": "ln(1 + naive_mean_2)"}
query("prediction_correlation", ("model_a", "model_b"), SC + f", z AS (SELECT z_target, {', '.join(f'{x} AS {k}' for k, x in Z3.items())} FROM sc) " + " UNION ALL ".join(
    f"SELECT '{a}' AS model_a, '{b}' AS model_b, corr({a}, {b}) AS prediction_corr, corr({a} - z_target, {b} - z_target) AS error_corr FROM z" for a, b in (("z_a", "z_b"), ("z_a", "z_c"), ("z_b", "z_c"))))(
    lambda t: M.prediction_correlation(scored(t).withColumns({"z_a": log_amount("prediction"), "z_b": log_amount("prediction2"), "z_c": log_amount("naive_mean_2")}), list(Z3), "z_target"))
query("error_overlap", (), SC + """SELECT corr(p, p2) AS score_corr, corr(a, b) AS error_corr, avg(CASE WHEN a > 0.5 AND b < 0.5 THEN 1 ELSE 0 END) AS share_fixed, avg(CASE WHEN a < 0.5 AND b > 0.5 THEN 1 ELSE 0 END) AS share_broken
 FROM (SELECT p, p2, abs(will_buy - p) AS a, abs(will_buy - p2) AS b FROM sc)""")(lambda t: M.error_overlap(scored(t), "p", "p2"))
query("cv_summary", ("model",), SC + ", f AS (" + " UNION ALL ".join(f"SELECT anchor_date, 'naive_{k}' AS model, sqrt(avg(pow(ln(1 + naive_{k}) - ln(1 + target), 2))) AS rmsle FROM sc GROUP BY 1" for k in NAIVE_SQL) +
      ") SELECT model, count(*) AS n_folds, avg(rmsle) AS mean_score, stddev_pop(rmsle) AS std_score, min(rmsle) AS best, max(rmsle) AS worst FROM f GROUP BY 1")(
    lambda t: M.cv_summary(E.naive_scores(scored(t)), "forecast", "anchor_date").withColumnRenamed("forecast", "model"))
MCC = """tp * 1.0 AS tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
 CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END AS mcc"""
query("threshold_metrics", ("rule",), SC + f""", {CURVE_SQL}, best AS (SELECT v FROM pr ORDER BY 2 * tp / (picked + np) DESC, v LIMIT 1),
 th AS (SELECT 'fixed' AS rule, 0.5::DOUBLE AS threshold UNION ALL SELECT 'best_f1', v FROM best)
 SELECT rule, threshold, {MCC} FROM (SELECT rule, threshold, count(*) FILTER (WHERE p2 >= threshold AND will_buy = 1)::DOUBLE AS tp, count(*) FILTER (WHERE p2 >= threshold AND will_buy = 0)::DOUBLE AS fp,
 count(*) FILTER (WHERE p2 < threshold AND will_buy = 1)::DOUBLE AS fn, count(*) FILTER (WHERE p2 < threshold AND will_buy = 0)::DOUBLE AS tn FROM sc, th GROUP BY 1, 2)""")(lambda t: M.threshold_metrics(scored(t), "p2"))
query("group_calibration", ("frequency_group",), SC + """SELECT frequency_group, count(*) AS n, avg(p) AS mean_p, avg(p2) AS mean_p2, avg(will_buy) AS actual_buy_rate, count(*) / sum(count(*)) OVER () AS share FROM (SELECT *,
 CASE WHEN was_active = 0 THEN '0_orders' WHEN to_ord_sum_90d - 1 <= 0 THEN '1_order' WHEN to_ord_sum_90d - 1 <= 1 THEN '2_orders' WHEN to_ord_sum_90d - 1 <= 4 THEN '3-5_orders' ELSE '6+_orders' END AS frequency_group FROM sc) GROUP BY 1""")(
    lambda t: M.group_calibration(scored(t).withColumn("_f", F.col("to_ord_sum_90d") - 1), "_f", ["p", "p2"], available="was_active"))
query("count_errors", (), SC + f"SELECT avg(abs(p2 - will_buy)) AS mae, sqrt(avg(pow(p2 - will_buy, 2))) AS rmse, (SELECT corr(rx, ry) FROM (SELECT {RANK('p2')} AS rx, {RANK('will_buy')} AS ry FROM sc)) AS spearman FROM sc")(
    lambda t: M.count_errors(scored(t), "p2", "will_buy"))
query("amount_errors", (), SC + """, f AS (SELECT regr_slope(z_target, ln(1 + prediction)) AS k, regr_intercept(z_target, ln(1 + prediction)) AS b FROM sc WHERE anchor_date < DATE '2001-01-01')
 SELECT sqrt(avg(sle)) AS raw_rmsle, sqrt(avg(pow(greatest(k * ln(1 + prediction) + b, 0) - z_target, 2))) AS calibrated_rmsle, max(k) AS scale, max(b) AS intercept FROM sc, f WHERE anchor_date >= DATE '2001-01-01'""")(
    lambda t: (lambda d: M.amount_errors(d.where("anchor_date < '2001-01-01'"), d.where("anchor_date >= '2001-01-01'"), "prediction"))(scored(t)))

# --- checks on rows with faults -------------------------------------------------------------

def hurt(df, faults, twice: int):
    """``df`` with columns changed for some users, and every ``twice``-th user's rows once more."""
    for column, divisor, rest, value in faults:
        df = df.withColumn(column, F.when(F.col("user_id") % divisor == rest, value).otherwise(F.col(column)))
    return df.unionByName(df.where(F.col("user_id") % twice == 0))


of = lambda divisor, rest: f"count(DISTINCT user_id) FILTER (WHERE user_id % {divisor} = {rest})"
query("check_bank_faults", A, SC + f"""SELECT anchor_date, count(DISTINCT user_id) AS n_users, {of(50, 0)} AS duplicate_users, count(DISTINCT user_id) FILTER (WHERE user_id % 40 = 1 OR user_id % 41 = 1) AS not_finite,
 {of(30, 2)} AS negative_targets FROM sc GROUP BY 1""")(
    lambda t: V.check_bank(hurt(scored(t), [("p", 40, 1, F.lit(float("nan"))), ("prediction", 41, 1, F.lit(None).cast("double")), ("target", 30, 2, F.lit(-1.0))], 50), ["p", "prediction"], "target"))
query("check_snapshot_faults", A, ctes(LOG, CV) + f"""SELECT anchor_date, count(DISTINCT user_id) AS n_users, (SELECT count(*) FROM customer) - count(DISTINCT user_id) AS missing_users, {of(25, 0)} AS duplicate_users,
 {of(20, 3)} AS history_after_anchor, count(DISTINCT user_id) FILTER (WHERE user_id % 17 = 5 OR user_id % 19 = 5) AS wrong_target_bounds, {of(13, 4)} AS wrong_target_nulls FROM a, (SELECT DISTINCT user_id FROM log) GROUP BY 1""")(
    lambda t: V.check_snapshot(hurt(S.technical_columns(W.aggregate(history(t.log, t.cv, back=30, ahead=30, columns=["gmv"]), [sum_where(target_window(30), "gmv").alias("target")])), [
        ("history_end", 20, 3, F.date_add("anchor_date", 1)), ("target_start", 17, 5, F.col("anchor_date")), ("target_end", 19, 5, F.date_add("anchor_date", 31)),
        ("target", 13, 4, F.lit(None).cast("double"))], 25), t.read("customer").agg(F.count(F.lit(1))).scalar()))
query("check_submission_faults", (), ctes(LOG) + """, tpl AS (SELECT DISTINCT user_id FROM log), sub AS (SELECT user_id + CASE WHEN user_id % 29 = 0 THEN 1000000 ELSE 0 END AS user_id, user_id AS own FROM tpl WHERE user_id % 31 <> 0)
 SELECT count(*) + count(*) FILTER (WHERE own % 23 = 0) AS n_rows, (SELECT count(*) FROM tpl) - count(*) FILTER (WHERE own % 29 <> 0) AS missing_users, count(*) FILTER (WHERE own % 29 = 0) AS extra_users,
 count(*) FILTER (WHERE own % 23 = 0) AS duplicate_users, count(*) FILTER (WHERE own % 37 = 0) + count(*) FILTER (WHERE own % 37 = 0 AND own % 23 = 0) AS not_finite,
 count(*) FILTER (WHERE own % 43 = 0 AND own % 37 <> 0) + count(*) FILTER (WHERE own % 43 = 0 AND own % 37 <> 0 AND own % 23 = 0) AS negative FROM sub""")(
    lambda t: V.check_submission(hurt(t.users.withColumn("predict", F.lit(1.0)).where("user_id % 31 <> 0"), [("predict", 43, 0, F.lit(-1.0)), ("predict", 37, 0, F.lit(float("inf")))], 23).withColumn(
        "user_id", F.when(F.col("user_id") % 29 == 0, F.col("user_id") + 1_000_000).otherwise(F.col("user_id"))), template(t)))
query("report_invariants_faults", (), SC + """SELECT 0 AS rmsle_squared_is_mse, 0 AS states_cover_all_rows, 0 AS weighted_mse_is_mse, 0 AS shares_sum_to_one, 0 AS error_shares_sum_to_one,
 abs(avg(CASE WHEN user_id % 7 <> 0 AND will_buy = 1 THEN 1.0 ELSE 0 END) - avg(will_buy)) AS buy_rate_from_states FROM sc""")(
    lambda t: M.report_invariants(scored(t).withColumn("transition_state", F.when(F.col("user_id") % 7 == 0, F.lit("00")).otherwise(F.col("transition_state")))))
query("log_audit_faults", (), ctes(LOG) + """, l AS (SELECT user_id, event_date, CASE WHEN user_id % 11 = 3 THEN NULL ELSE cat END AS cat, CASE WHEN user_id % 9 = 2 THEN to_ord + 1 ELSE to_ord END AS to_ord, search_to_ord, cat_to_ord,
 CASE WHEN user_id % 10 = 7 THEN gmv + 1 ELSE gmv END AS gmv, gmv_search, gmv_cat, unnest(CASE WHEN user_id % 15 = 0 THEN [1, 2] ELSE [1] END) AS copy FROM log)
 SELECT count(*) AS n_rows, coalesce(sum(CASE WHEN user_id % 15 = 0 THEN 1 END), 0) AS n_duplicate_rows, count(*) FILTER (WHERE cat IS NULL) AS n_nulls, avg(CASE WHEN to_ord = search_to_ord + cat_to_ord THEN 1 ELSE 0 END) AS orders_match_rate,
 avg(CASE WHEN abs(gmv - gmv_search - gmv_cat) < 0.005 THEN 1 ELSE 0 END) AS amount_match_rate FROM l""")(
    lambda t: V.log_audit(hurt(t.log, [("cat", 11, 3, F.lit(None).cast("long")), ("to_ord", 9, 2, F.col("to_ord") + 1), ("gmv", 10, 7, F.col("gmv") + 1)], 15)))
