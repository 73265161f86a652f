"""Queries for derived ratios, cadence, purchase models, snapshots and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import anchors as A
from tidemark.operators import btyd as B
from tidemark.operators import cadence as C
from tidemark.operators import derived as D
from tidemark.operators import labels as L
from tidemark.operators import sequences as Q
from tidemark.operators import snapshot as S
from tidemark.operators import windows as W
from tidemark.registry.base import (
    CLICKS, CV, EVENT_CTE, HIST, QUARTER_CTE, LOG, PER_USER, clip_sql, ctes, flag_sql, n, query, s, since, span,
)
from tidemark.registry.features import (
    ACTIVITY_SQL, AT_ANCHOR_SQL, BUY, CALENDAR_SQL, CONTEXT_SQL, DYNAMICS_SQL, EWMA_SQL, FILLED, HOLIDAY_SQL, LABELS_SQL, PLATFORM_SQL,
    PUBLIC_SQL, SHORT_SQL, SPARSE_SQL, SPIKE, lifetime_sql, recency_sql,
)

# --- derived --------------------------------------------------------------------------------

RATE_NAMES, RATE_SQL = [], []
for _base in ("gmv_sum", "to_ord_sum", "to_cart_sum", "searches_sum", "active_days", "purchase_days", "search_days", "cart_days"):
    _name = _base.replace("_sum", "")
    for _d in (7, 14, 30, 60, 90):
        RATE_SQL.append(f"{_base}_{_d}d / {_d}.0 AS {_name}_rate_{_d}d")
    for _a, _b in ((7, 30), (14, 60), (30, 90)):
        RATE_SQL += [f"{_base}_{_a}d / {_a}.0 - {_base}_{_b}d / {_b}.0 AS {_name}_rate_diff_{_a}_{_b}d",
                     f"{_base}_{_a}d / ({_base}_{_b}d + 1e-5) AS {_name}_ratio_{_a}_{_b}d",
                     f"{flag_sql(f'{_base}_{_b}d = 0')} AS {_name}_is_zero_denom_{_a}_{_b}d"]
RATE_NAMES = [x.rsplit(" AS ", 1)[1] for x in RATE_SQL]
BASE90 = f"f AS (SELECT anchor_date, user_id, {ACTIVITY_SQL}, {lifetime_sql(89)} {PER_USER})"


def base90(t):
    cols = W.SNAPSHOT_METRICS
    hist = W.history(t.log, t.cv, back=90, columns=cols)
    return W.fill(W.aggregate(hist, W.window_activity_exprs() + W.lifetime_exprs()), recency_names=["customer_age_days"])


query("rates_ratios", sql=ctes(LOG, CV, HIST, BASE90) + f"SELECT anchor_date, user_id, {', '.join(RATE_SQL)} FROM f")(
    lambda t: D.rates_ratios(base90(t)).select("anchor_date", "user_id", *RATE_NAMES))
VS_SQL = f"""90 / (purchase_days_90d + 1e-5) AS approx_order_interval_90d, days_since_last_order / (90 / (purchase_days_90d + 1e-5) + 1e-5) AS recency_ratio_90d,
 gmv_sum_30d / (global_gmv_per_active_30d + 1e-5) AS user_gmv_vs_global_30d,
 active_days_30d / (global_dau_30d_mean * 30 / (SELECT count(DISTINCT user_id) FROM log) + 1e-5) AS user_active_vs_global_30d"""
query("interval_vs_platform", sql=ctes(LOG, CV, HIST, BASE90, PLATFORM_SQL, AT_ANCHOR_SQL) + f"SELECT anchor_date, user_id, {VS_SQL} FROM f JOIN pa USING (anchor_date)")(
    lambda t: D.interval_vs_platform(base90(t).join(F.broadcast(W.platform_at_anchor(W.platform_daily(t.log), t.cv)), "anchor_date"), S.index_size(t.log)).select(
        "anchor_date", "user_id", "approx_order_interval_90d", "recency_ratio_90d", "user_gmv_vs_global_30d", "user_active_vs_global_30d"))
SEGMENT_SQL = """CASE WHEN customer_age_days < 30 THEN 0 WHEN days_since_last_activity >= 90 THEN 5
 WHEN has_ever_ordered = 0 AND days_since_last_activity <= 14 THEN 1 WHEN has_ever_ordered = 0 THEN 2
 WHEN days_since_last_activity <= 14 THEN 3 ELSE 4 END AS user_segment_id"""
query("user_segment", sql=ctes(LOG, CV, HIST, BASE90) + f"SELECT anchor_date, user_id, {SEGMENT_SQL} FROM f")(
    lambda t: D.user_segment(base90(t)).select("anchor_date", "user_id", "user_segment_id"))

SPARSE_LIFE = f"""{since('true', 100000, '999')} AS days_since_last_activity, {since(BUY, 100000, '999')} AS days_since_last_order,
 {since('to_cart > 0', 100000, '999')} AS days_since_last_cart, {since('gmv > 0', 100000, '999')} AS days_since_last_gmv, {since('cat > 0', 100000, '999')} AS days_since_last_cat,
 coalesce(max(age) FILTER (WHERE age >= 0), 999) AS customer_age_days,
 {n(0, 100000, '(searches > 0 OR to_cart > 0 OR to_ord > 0 OR gmv > 0 OR cat > 0)')} AS lifetime_active_days,
 coalesce(max(gmv) FILTER (WHERE {span(0, 364)}), 0) AS max_single_day_gmv_365d"""
SPARSE_BASE = f"f0 AS (SELECT anchor_date, user_id, {SPARSE_SQL}, {SPARSE_LIFE}, {EWMA_SQL} {PER_USER}), f AS (SELECT *, {clip_sql('(customer_age_days - days_since_last_order) / CASE WHEN order_days_365d > 1 THEN order_days_365d - 1 ELSE 1.0 END', 1, 365)} AS mean_order_interval_365d FROM f0)"
BEHAVIOUR = {
    "recency_to_cadence_ratio": clip_sql("days_since_last_order / mean_order_interval_365d", 0, 50),
    "cycle_phase": clip_sql("(CAST(days_since_last_order AS DOUBLE) % CAST(mean_order_interval_365d AS DOUBLE)) / mean_order_interval_365d", 0, 1),
    "is_cycle_due_30d": flag_sql("days_since_last_order + 30 >= mean_order_interval_365d"),
    "search_without_order_gap": clip_sql("days_since_last_order - days_since_last_activity", 0, 999),
    "cart_intent_gap": clip_sql("days_since_last_order - days_since_last_cart", 0, 999),
    "cat_without_order_gap": clip_sql("days_since_last_order - days_since_last_cat", 0, 999),
    **{f"mean_ticket_gmv_{d}d": clip_sql(f"gmv_sum_{d}d / (orders_sum_{d}d + 0.1)", 0, 100000) for d in (365, 90, 30, 7)},
    "max_to_mean_gmv_ratio": clip_sql("max_single_day_gmv_365d / (gmv_sum_365d / (orders_sum_365d + 0.1) + 1)", 0, 50),
    "gmv_to_search_ratio_90d": clip_sql("gmv_sum_90d / (searches_sum_90d + 1)", 0, 10000),
    "active_to_cart_rate_90d": clip_sql("cart_days_90d / (active_days_90d + 0.1)", 0, 1),
    "cart_to_order_rate_90d": clip_sql("order_days_90d / (cart_days_90d + 0.1)", 0, 10),
    **{f"cart_drop_intensity_{d}d": clip_sql(f"carts_sum_{d}d - orders_sum_{d}d", 0, 9999) for d in (90, 30, 7)},
    **{f"cat_share_of_browsing_{d}d": clip_sql(f"cat_sum_{d}d / (searches_sum_{d}d + cat_sum_{d}d + 0.1)", 0, 1) for d in (90, 30, 7)},
    **{f"cat_gmv_share_{d}d": clip_sql(f"gmv_cat_sum_{d}d / (gmv_sum_{d}d + 0.1)", 0, 1) for d in (90, 30)},
    "search_gmv_share_90d": clip_sql("gmv_search_sum_90d / (gmv_sum_90d + 0.1)", 0, 1),
    **{f"search_to_order_rate_{d}d": clip_sql(f"search_orders_sum_{d}d / (searches_sum_{d}d + 0.1)", 0, 10) for d in (90, 30, 7)},
    **{f"cat_to_order_rate_{d}d": clip_sql(f"cat_orders_sum_{d}d / (cat_sum_{d}d + 0.1)", 0, 10) for d in (90, 30)},
    **{f"search_to_cart_rate_{d}d": clip_sql(f"search_carts_sum_{d}d / (searches_sum_{d}d + 0.1)", 0, 10) for d in (90, 30)},
    **{f"cat_to_cart_rate_{d}d": clip_sql(f"cat_carts_sum_{d}d / (cat_sum_{d}d + 0.1)", 0, 10) for d in (90, 30)},
    **{f"{k}_momentum_7_to_30": clip_sql(f"ewma_{m}_tau7 / (ewma_{m}_tau30 + 0.1)", 0, 20) for k, m in {"cat": "cat", "search": "searches", "cart": "carts", "gmv": "gmv"}.items()},
    "searches_decay_14_to_60": clip_sql("searches_sum_14d / (searches_sum_60d * (14.0::DOUBLE / 60) + 1)", 0, 20),
    "orders_decay_14_to_60": clip_sql("orders_sum_14d / (orders_sum_60d * (14.0::DOUBLE / 60) + 0.1)", 0, 20),
    "cart_decay_14_to_60": clip_sql("cart_days_14d / (cart_days_60d * (14.0::DOUBLE / 60) + 0.1)", 0, 20),
    "is_searching_dormant": flag_sql("days_since_last_order > 30 AND days_since_last_activity <= 7"),
    "is_carting_dormant": flag_sql("days_since_last_order > 30 AND days_since_last_cart <= 14"),
    "dormant_search_density": clip_sql("searches_sum_30d / (customer_age_days + 1)", 0, 100),
    "is_overdue": flag_sql("days_since_last_order > 1.5 * mean_order_interval_365d"),
    "cart_to_search_ratio_30d": clip_sql("cart_days_30d / (active_days_30d + 0.1)", 0, 10),
    **{f"{k}_velocity_30_to_90": f"{m}_30d / ({m}_90d / 3 + {c})" for k, m, c in
       (("order", "order_days", 0.1), ("cart", "cart_days", 0.1), ("searches", "searches_sum", 1), ("gmv", "gmv_sum", 1))},
    **{f"{k}_velocity_7_to_30": f"{m}_7d / ({m}_30d * (7.0::DOUBLE / 30) + {c})" for k, m, c in
       (("order", "order_days", 0.1), ("cart", "cart_days", 0.1), ("searches", "searches_sum", 1), ("gmv", "gmv_sum", 1))},
    **{f"cart_conversion_rate_{d}d": clip_sql(f"orders_sum_{d}d / (carts_sum_{d}d + 0.1)", 0, 10) for d in (30, 7)},
    "ticket_growth_30_to_90": clip_sql("(gmv_sum_30d / (orders_sum_30d + 0.1)) / (gmv_sum_90d / (orders_sum_90d + 0.1) + 1)", 0, 20),
    "ticket_growth_7_to_30": clip_sql("(gmv_sum_7d / (orders_sum_7d + 0.1)) / (gmv_sum_30d / (orders_sum_30d + 0.1) + 1)", 0, 20),
    "order_density_lifetime": clip_sql("order_days_365d / (customer_age_days + 1)", 0, 1),
    "active_density_lifetime": clip_sql("lifetime_active_days / (customer_age_days + 1)", 0, 1),
    "search_vs_cat_order_ratio_90d": clip_sql("(search_orders_sum_90d + 0.1) / (cat_orders_sum_90d + 0.1)", 0, 50),
    "search_vs_cat_gmv_ratio_90d": clip_sql("(gmv_search_sum_90d + 0.1) / (gmv_cat_sum_90d + 0.1)", 0, 50),
}
BEHAVIOUR_SQL = ", ".join(f"{x} AS {k}" for k, x in BEHAVIOUR.items())


def sparse_base(t):
    hist = W.history(t.log, t.quarters, columns=list(W.SPARSE_METRICS))
    return W.fill(W.aggregate(hist, W.sparse_window_exprs() + W.sparse_lifetime_exprs() + W.ewma_exprs()), recency_names=["customer_age_days"])


query("behaviour_features", sql=ctes(LOG, QUARTER_CTE, HIST, SPARSE_BASE) + f"SELECT anchor_date, user_id, mean_order_interval_365d, {BEHAVIOUR_SQL} FROM f")(
    lambda t: D.behaviour_features(sparse_base(t)).select("anchor_date", "user_id", "mean_order_interval_365d", *BEHAVIOUR))

INTENT = {
    **{f"decay_{m}_7d_vs_30d": f"{m}_7d / ({m}_30d + 1e-4)" for m in ("searches", "carts", "orders", "gmv")},
    **{f"decay_{m}_3d_vs_14d": f"{m}_3d / ({m}_14d + 1e-4)" for m in ("searches", "carts")},
    **{f"diff_{m}_7d_norm_30d": f"{m}_7d - {m}_30d / 4.2857" for m in ("searches", "carts")},
    **{f"diff_{m}_14d_norm_60d": f"{m}_14d - {m}_60d / 4.2857" for m in ("orders", "gmv")},
    **{f"intent_{k}_without_order_{d}d": flag_sql(f"{m}_{d}d > 0 AND orders_{d}d = 0") for d in (7, 3) for k, m in {"search": "searches", "cart": "carts"}.items()},
    **{f"intent_unfinished_funnel_{d}d": f"carts_{d}d - orders_{d}d" for d in (3, 7)},
    **{f"intent_{k}_accel_3d_vs_14d": f"({m}_3d / 3.0) / ({m}_14d / 14.0 + 1e-4)" for k, m in {"search": "searches", "cart": "carts"}.items()},
}
INTENT_SQL = ", ".join(f"{x} AS {k}" for k, x in INTENT.items())
query("decay_intent", sql=ctes(CLICKS, EVENT_CTE, HIST) + f", f AS (SELECT anchor_date, user_id, {SHORT_SQL} {PER_USER}) SELECT anchor_date, user_id, {INTENT_SQL} FROM f")(
    lambda t: D.decay_intent(W.short_window_sums(t.clicks, t.event_anchors)).select("anchor_date", "user_id", *INTENT))
MISSING_SQL = ", ".join(f"{since(c, 364, '365')} AS days_since_last_{k}, {flag_sql(since(c, 364) + ' IS NULL')} AS is_missing_last_{k}"
                        for k, c in {"activity": "true", "search": "searches > 0", "cart": "to_cart > 0", "order": "to_ord > 0"}.items())
query("missing_flags", sql=ctes(LOG, QUARTER_CTE, HIST) + f"SELECT anchor_date, user_id, {MISSING_SQL} {PER_USER}")(
    lambda t: D.missing_flags(W.aggregate(W.history(t.log, t.quarters, back=365), W.recency_exprs())))


SCALED = ["gmv_sum_30d", "to_ord_sum_90d", "days_since_last_order"]
query("standardise_features", sql=ctes(LOG, QUARTER_CTE, HIST) + f""", f AS (SELECT anchor_date, user_id, {s('gmv', 0, 29)} AS gmv_sum_30d, {s('to_ord', 0, 89)} AS to_ord_sum_90d,
 {since('to_ord > 0', 89, '999')} AS days_since_last_order {PER_USER}), st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, greatest(stddev_pop({c}), 1e-6) AS s_{c}' for c in SCALED)} FROM f WHERE anchor_date < DATE '2001-01-01')
 SELECT anchor_date, user_id, {', '.join(f"{clip_sql(f'({c} - m_{c}) / s_{c}', -8, 8)} AS {c}" for c in SCALED)} FROM f, st""")(
    lambda t: (lambda f: D.standardise_features(f, D.fit_scaler(f.where("anchor_date < '2001-01-01'"), SCALED), SCALED))(
        W.fill(W.aggregate(W.history(t.log, t.quarters, back=90), W.window_agg_exprs() + W.fold_recency_exprs())).select("anchor_date", "user_id", *SCALED)))

# --- cadence --------------------------------------------------------------------------------

GAPS_SQL = """b AS (SELECT anchor_date, user_id, event_date, age, lag(age) OVER (PARTITION BY anchor_date, user_id ORDER BY event_date) - age AS gap
 FROM h WHERE age BETWEEN 0 AND 179 AND gmv > 0),
 act AS (SELECT anchor_date, user_id, age, lag(age) OVER (PARTITION BY anchor_date, user_id ORDER BY event_date) - age AS act_gap FROM h WHERE age BETWEEN 0 AND 179),
 idx AS (SELECT anchor_date, user_id FROM a, u)"""
GAP_AGG = """count(gap) AS number_of_observed_gaps, max_by(gap, event_date) FILTER (WHERE gap IS NOT NULL) AS last_gap,
 (list(gap ORDER BY event_date DESC) FILTER (WHERE gap IS NOT NULL))[2] AS prev_gap,
 avg(gap) AS mean_gap, median(gap) AS median_gap, stddev_samp(gap) AS std_gap, min(gap) AS min_gap, max(gap) AS max_gap,
 list_sort(list(gap) FILTER (WHERE gap IS NOT NULL))[1 + CAST(round((count(gap) - 1) * 0.25) AS INT)] AS p25_gap,
 list_sort(list(gap) FILTER (WHERE gap IS NOT NULL))[1 + CAST(round((count(gap) - 1) * 0.75) AS INT)] AS p75_gap,
 count(*) AS buy_days, count(*) FILTER (WHERE age < 90) AS buy_days_90, min(age) AS since_last, max(age) AS since_first,
 list_sort(list(age))[2] AS since_2, list_sort(list(age))[3] AS since_3"""
GAP_NAMES = {"last": "last", "previous": "prev", "mean": "mean", "median": "median", "std": "std", "min": "min", "max": "max", "p25": "p25", "p75": "p75"}
CADENCE_SQL = f"g AS (SELECT anchor_date, user_id, {GAP_AGG} FROM b GROUP BY 1, 2), w AS (SELECT anchor_date, user_id, max(act_gap) AS streak, count(*) FILTER (WHERE age // 7 < 4) AS w30, count(*) FILTER (WHERE age // 7 < 13) AS w90, count(DISTINCT age // 7) AS w180, max(age) AS hist_span, count(*) AS days FROM act GROUP BY 1, 2)"
query("purchase_gaps", ("anchor_date", "user_id", "event_date"), ctes(LOG, QUARTER_CTE, HIST, GAPS_SQL) + "SELECT * FROM b WHERE gap IS NOT NULL")(
    lambda t: C.purchase_gaps(t.log, t.quarters))
query("gap_stats", sql=ctes(LOG, QUARTER_CTE, HIST, GAPS_SQL, CADENCE_SQL) + f"SELECT anchor_date, user_id, coalesce(number_of_observed_gaps, 0) AS number_of_observed_gaps, {', '.join(f'{v}_gap AS {k}_interpurchase_gap' for k, v in GAP_NAMES.items())} FROM idx LEFT JOIN g USING (anchor_date, user_id)")(
    lambda t: C.gap_stats(t.log, t.quarters))
query("nth_last_purchase", sql=ctes(LOG, QUARTER_CTE, HIST, GAPS_SQL, CADENCE_SQL) + "SELECT anchor_date, user_id, coalesce(since_2, 365) AS days_since_second_last_purchase, coalesce(since_3, 365) AS days_since_third_last_purchase FROM idx LEFT JOIN g USING (anchor_date, user_id)")(
    lambda t: C.nth_last_purchase(t.log, t.quarters))
query("activity_weeks", sql=ctes(LOG, QUARTER_CTE, HIST, GAPS_SQL, CADENCE_SQL) + "SELECT anchor_date, user_id, streak AS longest_inactivity_streak, coalesce(w30, 0) AS active_weeks_30d, coalesce(w90, 0) AS active_weeks_90d, coalesce(w180, 0) AS active_weeks_180d, hist_span AS history_span, coalesce(days, 0) AS history_days FROM idx LEFT JOIN w USING (anchor_date, user_id)")(
    lambda t: C.activity_weeks(t.log, t.quarters))
CADENCE_FINAL = f"""cf AS (SELECT anchor_date, user_id, coalesce(buy_days, 0) AS purchase_days_180d, coalesce(since_first, 365) AS days_since_first_purchase,
 coalesce(since_2, 365) AS days_since_second_last_purchase, coalesce(since_3, 365) AS days_since_third_last_purchase,
 coalesce(number_of_observed_gaps, 0) AS number_of_observed_gaps,
 {', '.join(f"coalesce({v}_gap, {0 if k == 'std' else 180}) AS {k}_interpurchase_gap" for k, v in GAP_NAMES.items())},
 coalesce(streak, 180) AS longest_inactivity_streak, coalesce(w30, 0) AS active_weeks_30d, coalesce(w90, 0) AS active_weeks_90d, coalesce(w180, 0) AS active_weeks_180d,
 {flag_sql('coalesce(buy_days, 0) >= 2')} AS has_2_purchase_days, {flag_sql('coalesce(buy_days, 0) >= 3')} AS has_3_purchase_days, {flag_sql('coalesce(buy_days, 0) >= 2')} AS cycle_estimate_available,
 coalesce(buy_days_90, 0) / 13 AS share_of_weeks_with_purchase_90d, coalesce(buy_days, 0) / 26 AS share_of_weeks_with_purchase_180d,
 coalesce(days, 0) / (coalesce(w180, 1) + 1e-4) AS mean_active_streak, 1 / (coalesce(std_gap, 0) + 1) AS purchase_week_regularness, coalesce(w180, 0) / 26 AS active_week_entropy,
 {flag_sql('coalesce(hist_span, 0) < 180')} AS is_history_censored,
 coalesce(std_gap, 0) / (coalesce(mean_gap, 180) + 1e-4) AS cv_interpurchase_gap, coalesce(last_gap, 180) / (coalesce(prev_gap, 180) + 1e-4) AS trend_interpurchase_gap,
 CASE WHEN buy_days >= 2 THEN since_last / (median_gap + 1e-4) ELSE 0 END AS gap_ratio, CASE WHEN buy_days >= 2 THEN since_last - median_gap ELSE 0 END AS overdue_days,
 CASE WHEN buy_days >= 2 THEN (since_last - mean_gap) / (coalesce(std_gap, 0) + 1e-4) ELSE 0 END AS gap_zscore,
 {flag_sql('buy_days >= 2 AND since_last > median_gap')} AS is_cycle_overdue
 FROM idx LEFT JOIN g USING (anchor_date, user_id) LEFT JOIN w USING (anchor_date, user_id))"""
query("cadence_features", sql=ctes(LOG, QUARTER_CTE, HIST, GAPS_SQL, CADENCE_SQL, CADENCE_FINAL) + "SELECT * FROM cf")(lambda t: C.cadence_features(t.log, t.quarters))
PROPENSITY_SQL = f"""win AS (SELECT anchor_date AS w, user_id, {s('gmv', -30, -1)} AS x {PER_USER}),
 pp0 AS (SELECT a.anchor_date, u.user_id, count(w) AS n, count(*) FILTER (WHERE x > 0) AS k, coalesce(sum(ln(1 + x)), 0) AS z
  FROM a CROSS JOIN u LEFT JOIN win ON win.user_id = u.user_id AND w + 30 <= a.anchor_date GROUP BY 1, 2),
 pp AS (SELECT anchor_date, user_id, CASE WHEN n > 0 THEN k / n ELSE 0 END AS personal_buy_rate_raw, (k + 5 * 0.5398) / (n + 5) AS personal_buy_rate_k5,
 (k + 20 * 0.5398) / (n + 20) AS personal_buy_rate_k20, (k + 5 * 0.28) / (n + 5) AS personal_react_rate_k5,
 CASE WHEN n > 0 THEN (n - k + 5 * 0.26) / (n + 5) ELSE 0.257 END AS personal_churn_rate_k5, CASE WHEN k > 0 THEN z / k ELSE 0 END AS personal_mean_log_gmv,
 n AS n_completed_past_target_windows, CASE WHEN n > 0 THEN 1 ELSE 0 END AS propensity_available_flag FROM pp0)"""
query("personal_propensity", sql=ctes(LOG, QUARTER_CTE, HIST, PROPENSITY_SQL) + "SELECT * FROM pp")(lambda t: C.personal_propensity(t.log, t.quarters))


def last_year_sql(prefix: str, start: str, pairs: dict[str, str]) -> str:
    """Aggregates over 30 days from ``start``, 0 when that lies before the log."""
    cols = ", ".join(f"CASE WHEN {start} >= any_value(first) THEN {x} ELSE 0 END AS {prefix}{k}" for k, x in pairs.items())
    return f"SELECT a.anchor_date, u.user_id, {cols}, CASE WHEN {start} >= any_value(first) THEN 1 ELSE 0 END AS avail FROM a CROSS JOIN u CROSS JOIN (SELECT min(event_date) AS first FROM log) LEFT JOIN log l ON l.user_id = u.user_id AND l.event_date BETWEEN {start} AND {start} + 29 GROUP BY a.anchor_date, u.user_id"


EXACT_SQL = "ly AS (SELECT * EXCLUDE (avail), avail AS ly_exact_target_available FROM (" + last_year_sql("ly_exact_target_", "CAST(a.anchor_date - 364 AS DATE)", {
    "buy": flag_sql("coalesce(sum(gmv), 0) > 0"), "gmv": "coalesce(sum(gmv), 0)", "log_gmv": "ln(1 + coalesce(sum(gmv), 0))",
    "purchase_days": f"count(*) FILTER (WHERE {BUY})", "orders": "coalesce(sum(to_ord), 0)", "searches": "coalesce(sum(searches), 0)", "carts": "coalesce(sum(to_cart), 0)",
    "active_days": "count(l.user_id)"}) + "))"
LY_SQL = "lyc AS (SELECT * EXCLUDE (avail), avail AS ly_window_available FROM (" + last_year_sql("ly_target_window_", "CAST(CAST(a.anchor_date - INTERVAL 1 YEAR AS DATE) + 1 AS DATE)", {
    "buyer": flag_sql("coalesce(sum(gmv), 0) > 0"), "gmv": "coalesce(sum(gmv), 0)", "orders": "coalesce(sum(to_ord), 0)", "purchase_days": "count(*) FILTER (WHERE to_ord > 0)",
    "active_days": "count(l.user_id)", "searches": "coalesce(sum(searches), 0)", "carts": "coalesce(sum(to_cart), 0)"}) + "))"
query("last_year_exact", sql=ctes(LOG, QUARTER_CTE, HIST, EXACT_SQL) + "SELECT * FROM ly")(lambda t: C.last_year_exact(t.log, t.quarters))
query("last_year_calendar", sql=ctes(LOG, QUARTER_CTE, HIST, LY_SQL) + "SELECT * FROM lyc")(lambda t: C.last_year_calendar(t.log, t.quarters))
LIFE_SQL = f"""lf AS (SELECT *, {INTENT_SQL} FROM (SELECT anchor_date, user_id, {MISSING_SQL}, {SHORT_SQL},
 coalesce(max(age) FILTER (WHERE {span(0, 364)}), 0) AS user_tenure_days, {n(0, 29)} AS active_days_30d, {n(0, 89)} AS active_days_90d,
 {n(0, 29, 'to_ord > 0')} AS purchase_days_30d, {n(0, 89, 'to_ord > 0')} AS purchase_days_90d {PER_USER}))"""
query("lifecycle_features", sql=ctes(LOG, QUARTER_CTE, HIST, LIFE_SQL) + "SELECT * FROM lf")(lambda t: C.lifecycle_features(t.log, t.quarters))
query("transition_feature_set", sql=ctes(LOG, QUARTER_CTE, HIST, LIFE_SQL, LY_SQL, PUBLIC_SQL, CONTEXT_SQL) +
      "SELECT lf.*, lyc.* EXCLUDE (anchor_date, user_id), ctx.* EXCLUDE (anchor_date) FROM lf JOIN lyc USING (anchor_date, user_id) JOIN ctx USING (anchor_date)")(
    lambda t: C.transition_feature_set(t.log, t.quarters))
query("activity_window_report", ("anchor_date", "window_days"), ctes(LOG, QUARTER_CTE, HIST) + f""", x AS (SELECT anchor_date, {flag_sql(s('gmv', 0, 29) + ' > 0')} AS a30,
 {flag_sql(s('gmv', 0, 59) + ' > 0')} AS a60, {flag_sql(s('gmv', 0, 89) + ' > 0')} AS a90, {s('gmv', -30, -1)} AS f {PER_USER}),
 y AS (SELECT anchor_date, f, 30 AS window_days, a30 AS act, 0 AS inner_act FROM x UNION ALL SELECT anchor_date, f, 60, a60, a30 FROM x UNION ALL SELECT anchor_date, f, 90, a90, a60 FROM x)
 SELECT anchor_date, window_days, count(*) AS n_users, count(*) FILTER (WHERE act = 1) AS n_active, count(*) FILTER (WHERE act = 1 AND inner_act = 0) AS n_borderline,
 count(*) FILTER (WHERE act = 1 AND inner_act = 0 AND f > 0) AS n_borderline_buyers, count(*) FILTER (WHERE act = 0 AND f = 0) AS n_00, count(*) FILTER (WHERE act = 0 AND f > 0) AS n_01,
 count(*) FILTER (WHERE act = 1 AND f = 0) AS n_10, count(*) FILTER (WHERE act = 1 AND f > 0) AS n_11,
 coalesce(sum(f) FILTER (WHERE act = 0), 0) AS reactivated_amount, coalesce(sum(f) FILTER (WHERE act = 1), 0) AS retained_amount FROM y GROUP BY 1, 2""")(
    lambda t: C.activity_window_report(t.log, t.quarters))

# --- purchase models ------------------------------------------------------------------------

RFM_WINDOW_SQL = f"""rw AS (SELECT anchor_date, user_id, greatest({n(0, 179, 'gmv > 0')} - 1, 0) AS btyd_frequency,
 coalesce(max(age) FILTER (WHERE {span(0, 179)} AND gmv > 0) - min(age) FILTER (WHERE {span(0, 179)} AND gmv > 0), 0) AS btyd_recency_days,
 coalesce(max(age) FILTER (WHERE {span(0, 179)} AND gmv > 0), 180) AS btyd_T_days, coalesce(avg(gmv) FILTER (WHERE {span(0, 179)} AND gmv > 0), 0) AS btyd_monetary_avg {PER_USER})"""
RFM_FULL_SQL = f"""rf AS (SELECT anchor_date, user_id, {flag_sql(n(0, 100000, 'gmv > 0') + ' > 0')} AS btyd_available, {n(0, 100000, 'gmv > 0')} AS btyd_n_purchases,
 greatest({n(0, 100000, 'gmv > 0')} - 1, 0) AS btyd_frequency, max(age) FILTER (WHERE age >= 0 AND gmv > 0) - min(age) FILTER (WHERE age >= 0 AND gmv > 0) AS btyd_recency,
 coalesce(max(age) FILTER (WHERE age >= 0 AND gmv > 0), anchor_date - (SELECT min(event_date) FROM log)) AS btyd_T,
 sum(gmv) FILTER (WHERE age >= 0 AND gmv > 0) / nullif({n(0, 100000, 'gmv > 0')}, 0) AS btyd_monetary_value {PER_USER})"""
query("rfm_window", sql=ctes(LOG, QUARTER_CTE, HIST, RFM_WINDOW_SQL) + "SELECT * FROM rw")(lambda t: B.rfm_window(t.log, t.quarters))
query("rfm_full", sql=ctes(LOG, QUARTER_CTE, HIST, RFM_FULL_SQL) + "SELECT * FROM rf")(lambda t: B.rfm_full(t.log, t.quarters))
MODEL = B.BgNbd()


def odds_sql(x: str, t: str, T: str, m: B.BgNbd = MODEL) -> str:
    return f"{m.a} / ({m.b} + greatest({x} - 1, 0)) * pow(({m.alpha} + {T}) / ({m.alpha} + {t}), {m.r} + {x})"


def expected_sql(x: str, t: str, T: str, h: int, m: B.BgNbd = MODEL) -> str:
    """Expected purchases with the series of 2F1 written through lgamma."""
    z = f"({h} / ({m.alpha} + {T} + {h}.0))"
    aa, bb, cc = f"({m.r} + {x})", f"({m.b} + {x})", f"({m.a + m.b - 1} + {x})"
    term = f"exp(lgamma({aa} + k) - lgamma({aa}) + lgamma({bb} + k) - lgamma({bb}) - lgamma({cc} + k) + lgamma({cc}) - lgamma(k + 1.0) + k * ln({z}))"
    series = f"list_sum(list_transform(range(0, 900), lambda k: {term}))"
    live = f"CASE WHEN {x} > 0 THEN 1 / (1 + {odds_sql(x, t, T, m)}) ELSE 1 END"
    return clip_sql(f"{cc} / ({m.a} - 1) * (1 - pow(({m.alpha} + {T}) / ({m.alpha} + {T} + {h}), {m.r} + {x}) * {series}) * {live}", 0, 2 * h)


ALIVE_SQL = f"CASE WHEN x > 0 THEN 1 / (1 + {odds_sql('x', 't', 'life')}) ELSE 1 END"
PREDICT_SQL = f"""tri AS (SELECT DISTINCT x, t, life FROM r), sc AS (SELECT x, t, life, {clip_sql(ALIVE_SQL, 0, 1)} AS p, {', '.join(f"{expected_sql('x', 't', 'life', h)} AS e{h}" for h in (7, 14, 30))} FROM tri)"""
query("bgnbd_predict", sql=ctes(LOG, QUARTER_CTE, HIST, RFM_FULL_SQL,
      "r AS (SELECT *, CAST(btyd_frequency AS DOUBLE) AS x, CAST(coalesce(btyd_recency, 0) AS DOUBLE) AS t, CAST(coalesce(btyd_T, 0) AS DOUBLE) AS life FROM rf)", PREDICT_SQL) + f"""
 SELECT r.* EXCLUDE (x, t, life), CASE WHEN btyd_available = 1 THEN p ELSE 0 END AS btyd_p_alive,
 CASE WHEN btyd_available = 1 THEN ln({clip_sql('p', 1e-7, '1 - 1e-7')} / (1 - {clip_sql('p', 1e-7, '1 - 1e-7')})) ELSE -15 END AS btyd_logit_p_alive,
 {', '.join(f"CASE WHEN btyd_available = 1 THEN e{h} ELSE 0 END AS btyd_expected_purchases_{h}d, CASE WHEN btyd_available = 1 THEN 1 - exp(-{clip_sql(f'e{h}', 0, 50)}) ELSE 0 END AS btyd_p_buy_{h}d, CASE WHEN btyd_available = 1 THEN exp(-{clip_sql(f'e{h}', 0, 50)}) ELSE 1 END AS btyd_p_zero_{h}d" for h in (7, 14, 30))}
 FROM r JOIN sc ON r.x = sc.x AND r.t = sc.t AND r.life = sc.life""")(lambda t: B.bgnbd_predict(B.rfm_full(t.log, t.quarters), MODEL))
MONEY_SQL = """fit AS (SELECT CASE WHEN n < 50 THEN 1.5 ELSE 2 END AS p, 3 AS q, CASE WHEN n < 50 THEN 1500 ELSE m END AS v FROM
 (SELECT count(*) AS n, avg(btyd_monetary_avg) AS m FROM rw WHERE btyd_frequency > 0 AND btyd_monetary_avg > 0))"""
query("gamma_gamma", sql=ctes(LOG, QUARTER_CTE, HIST, RFM_WINDOW_SQL, MONEY_SQL) + """SELECT rw.*, CASE WHEN btyd_frequency > 0
 THEN p * btyd_frequency / (p * btyd_frequency + q - 1) * btyd_monetary_avg + (1 - p * btyd_frequency / (p * btyd_frequency + q - 1)) * (v * p / (q - 1))
 ELSE v * p / (q - 1) END AS btyd_expected_monetary_value FROM rw, fit""")(lambda t: B.gamma_gamma(B.rfm_window(t.log, t.quarters)))
query("money_with_fallback", sql=ctes(LOG, QUARTER_CTE, HIST, RFM_FULL_SQL) + """, f AS (SELECT coalesce(avg(btyd_monetary_value) FILTER (WHERE btyd_frequency > 0), 50) AS fb FROM rf)
 SELECT rf.*, CASE WHEN btyd_frequency > 0 THEN 1 ELSE 0 END AS gamma_gamma_available, CASE WHEN btyd_frequency > 0
 THEN 1.5 * btyd_frequency / (1.5 * btyd_frequency + 2) * btyd_monetary_value + (1 - 1.5 * btyd_frequency / (1.5 * btyd_frequency + 2)) * 1125
 WHEN btyd_available = 1 THEN btyd_monetary_value ELSE fb END AS btyd_expected_monetary_value FROM rf, f""")(lambda t: B.money_with_fallback(B.rfm_full(t.log, t.quarters)))
BTYD_SQL = f"""r AS (SELECT *, CAST(btyd_frequency AS DOUBLE) AS x, CAST(btyd_recency_days AS DOUBLE) AS t, CAST(btyd_T_days AS DOUBLE) AS life FROM rw), {PREDICT_SQL},
 bt AS (SELECT anchor_date, user_id, btyd_frequency, btyd_recency_days, btyd_T_days, btyd_monetary_avg, p AS btyd_p_alive,
 ln({clip_sql('p', 1e-7, '1 - 1e-7')} / (1 - {clip_sql('p', 1e-7, '1 - 1e-7')})) AS btyd_logit_p_alive, e30 AS btyd_expected_purchases_30d,
 1 - exp(-e30) AS btyd_p_at_least_one_purchase_30d, exp(-e30) AS btyd_p_zero_purchase_30d, worth AS btyd_expected_monetary_value,
 e30 * worth AS btyd_expected_gmv_30d, ln(1 + e30 * worth) AS btyd_log_expected_gmv_30d FROM
 (SELECT r.*, p, e30, CASE WHEN r.x > 0 THEN 1.5 * r.x / (1.5 * r.x + 2) * btyd_monetary_avg + (1 - 1.5 * r.x / (1.5 * r.x + 2)) * 1125 ELSE 1125 END AS worth
  FROM r JOIN sc ON r.x = sc.x AND r.t = sc.t AND r.life = sc.life))"""
query("btyd_features", sql=ctes(LOG, QUARTER_CTE, HIST, RFM_WINDOW_SQL, BTYD_SQL) + "SELECT * FROM bt")(lambda t: B.btyd_features(t.log, t.quarters, MODEL, B.GammaGamma()))
query("btyd_classifier_features", sql=ctes(LOG, QUARTER_CTE, HIST, RFM_WINDOW_SQL, BTYD_SQL) +
      "SELECT anchor_date, user_id, btyd_p_at_least_one_purchase_30d AS btyd_p_buy_30d, btyd_expected_purchases_30d, btyd_p_alive FROM bt")(
    lambda t: B.btyd_features(t.log, t.quarters, MODEL, B.GammaGamma(), classifier_only=True))


@query("fit_bgnbd", ("parameter",))
def _(t):
    rfm = B.rfm_window(t.log, t.quarters)
    fitted = B.fit_bgnbd(rfm)
    score = B.log_likelihood(F.col("btyd_frequency"), F.col("btyd_recency_days"), F.col("btyd_T_days"), *(F.lit(v) for v in (fitted.r, fitted.alpha, fitted.a, fitted.b)))
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("parameter"), F.lit(v).alias("value")) for k, v in vars(fitted).items()]))
    return rfm.agg(F.avg(score).alias("mean_log_likelihood")).select("mean_log_likelihood", rows)


# --- snapshots ------------------------------------------------------------------------------

SNAP_SQL = f"""sn0 AS (SELECT anchor_date, user_id, {ACTIVITY_SQL}, {lifetime_sql(89)}, {DYNAMICS_SQL}, {s('gmv', -30, -1)} AS target FROM h2 GROUP BY anchor_date, user_id),
 sn AS (SELECT sn0.*, pa.* EXCLUDE (anchor_date), cal.* EXCLUDE (anchor_date), CAST(sn0.anchor_date - 89 AS DATE) AS history_start, sn0.anchor_date AS history_end,
 CAST(sn0.anchor_date + 1 AS DATE) AS target_start, CAST(sn0.anchor_date + 30 AS DATE) AS target_end, 90 AS available_history_days,
 {', '.join(RATE_SQL)}, {VS_SQL}, {SEGMENT_SQL}, {flag_sql('target > 0')} AS will_buy_30d FROM sn0 JOIN pa USING (anchor_date) JOIN cal USING (anchor_date))"""
SNAP_CTES = (LOG, QUARTER_CTE, HIST, SPIKE, PLATFORM_SQL, AT_ANCHOR_SQL, HOLIDAY_SQL, CALENDAR_SQL, SNAP_SQL)
TECH = ("history_start", "history_end", "target_start", "target_end")
query("snapshot", ("anchor_date", "user_id", *TECH), ctes(*SNAP_CTES) + "SELECT * FROM sn")(lambda t: S.snapshot(t.log, t.quarters))
query("sparse_snapshot", sql=ctes(LOG, QUARTER_CTE, HIST, SPARSE_BASE, RFM_WINDOW_SQL, BTYD_SQL) +
      f"SELECT f.*, {BEHAVIOUR_SQL}, bt.* EXCLUDE (anchor_date, user_id) FROM f JOIN bt USING (anchor_date, user_id)")(lambda t: S.sparse_snapshot(t.log, t.quarters))
query("feature_store", sql=ctes(*SNAP_CTES, LABELS_SQL) +
      "SELECT sn.* EXCLUDE (history_start, history_end, target_start, target_end, available_history_days, target, will_buy_30d), lab.* EXCLUDE (anchor_date, user_id) FROM sn JOIN lab USING (anchor_date, user_id)")(
    lambda t: S.feature_store(t.log, t.quarters))
query("join_feature_blocks", sql=ctes(LOG, QUARTER_CTE, HIST, GAPS_SQL, CADENCE_SQL, CADENCE_FINAL, PROPENSITY_SQL, EXACT_SQL, RFM_WINDOW_SQL, BTYD_SQL) + f""",
 base AS (SELECT anchor_date, user_id, {s('gmv', 0, 29)} AS gmv_sum_30d {PER_USER})
 SELECT base.*, cf.* EXCLUDE (anchor_date, user_id), pp.* EXCLUDE (anchor_date, user_id), ly.* EXCLUDE (anchor_date, user_id), bt.* EXCLUDE (anchor_date, user_id)
 FROM base JOIN cf USING (anchor_date, user_id) JOIN pp USING (anchor_date, user_id) JOIN ly USING (anchor_date, user_id) JOIN bt USING (anchor_date, user_id)""")(
    lambda t: S.join_feature_blocks(
        W.window_aggs(t.log, t.quarters, windows={"30d": (29, 0)}, metrics=["gmv"], aggs=["sum"]), C.cadence_features(t.log, t.quarters),
        C.personal_propensity(t.log, t.quarters), C.last_year_exact(t.log, t.quarters), B.btyd_features(t.log, t.quarters, MODEL, B.GammaGamma())))

CATALOG_SQL = f"""SELECT feature, CASE {' '.join(f"WHEN regexp_matches(feature, '{rule}') THEN '{group}'" for group, rule in D.CATALOG_RULES)} ELSE 'other' END AS feature_group, count(*) AS n_rows,
 count(*) FILTER (WHERE x IS NULL) AS n_missing, count(*) FILTER (WHERE abs(x) < 1e-9) AS n_zero, min(x) AS least, max(x) AS greatest, avg(x) AS mean, CASE WHEN min(x) < max(x) THEN 1 ELSE 0 END AS varies
 FROM (SELECT COLUMNS(* EXCLUDE ({', '.join(D.TECHNICAL)}, target, will_buy_30d))::DOUBLE FROM sn) UNPIVOT INCLUDE NULLS (x FOR feature IN (COLUMNS(*))) GROUP BY 1"""
query("feature_catalog", ("feature", "feature_group"), ctes(*SNAP_CTES) + CATALOG_SQL)(lambda t: D.feature_catalog(S.snapshot(t.log, t.quarters)).drop("n_distinct"))
query("feature_columns", ("feature",), ctes(*SNAP_CTES) + f"SELECT feature, n_rows FROM ({CATALOG_SQL}) WHERE varies = 1 AND NOT starts_with(feature, 'global_')")(
    lambda t: (lambda wide: D.feature_catalog(wide, D.feature_columns(wide, drop_noisy=True)).where("varies = 1").select("feature", "n_rows"))(S.snapshot(t.log, t.quarters)))

# --- sequences ------------------------------------------------------------------------------


def panel_sql(days: int, extra: str = "") -> str:
    return f"""SELECT a.anchor_date, u.user_id, CAST(k AS INT) AS day_index, CAST(a.anchor_date - {days - 1} + CAST(k AS INT) AS DATE) AS day,
 {', '.join(f'ln(1 + coalesce(l.{m}, 0)) AS {m}' for m in Q.PANEL_METRICS)}, CASE WHEN l.user_id IS NULL THEN 0 ELSE 1 END AS is_active,
 CASE WHEN l.gmv > 0 OR l.to_ord > 0 THEN 1 ELSE 0 END AS is_purchase_day,
 sin(2 * pi() * (isodow(CAST(a.anchor_date - {days - 1} + CAST(k AS INT) AS DATE)) - 1) / 7) AS sin_dow,
 cos(2 * pi() * (isodow(CAST(a.anchor_date - {days - 1} + CAST(k AS INT) AS DATE)) - 1) / 7) AS cos_dow, k / {days - 1} AS normalized_position
 FROM a CROSS JOIN u CROSS JOIN range({days}) AS t(k) LEFT JOIN log l ON l.user_id = u.user_id AND l.event_date = CAST(a.anchor_date - {days - 1} + CAST(k AS INT) AS DATE)"""


PANEL_KEYS = ("anchor_date", "user_id", "day")
query("dense_daily_panel", PANEL_KEYS, ctes(CLICKS, EVENT_CTE, HIST) + panel_sql(180))(lambda t: Q.dense_daily_panel(t.clicks, t.event_anchors, days=180))
query("observed_flag", PANEL_KEYS, ctes(CLICKS, EVENT_CTE, HIST) + f""", p AS ({panel_sql(180)}) SELECT anchor_date, user_id, day, day_index,
 {', '.join(f"CASE WHEN day >= DATE '2024-01-01' THEN {c} ELSE 0 END AS {c}" for c in [*Q.PANEL_METRICS, 'is_active', 'is_purchase_day', 'sin_dow', 'cos_dow', 'normalized_position'])},
 CASE WHEN day >= DATE '2024-01-01' THEN 1 ELSE 0 END AS is_observed FROM p""")(
    lambda t: Q.observed_flag(Q.dense_daily_panel(t.clicks, t.event_anchors, days=180), F.lit("2024-01-01").cast("date")))
query("history_slice", PANEL_KEYS, ctes(CLICKS, EVENT_CTE, HIST) + f", p AS ({panel_sql(180)}) SELECT anchor_date, user_id, day, gmv, is_active FROM p WHERE day_index >= 173")(
    lambda t: Q.history_slice(Q.panel_arrays(Q.dense_daily_panel(t.clicks, t.event_anchors, days=180)), 7).select(
        "anchor_date", "user_id", F.inline("days")).select("anchor_date", "user_id", "day", "gmv", "is_active"))


def events_sql(keep: int) -> str:
    return f"""ev AS (SELECT *, row_number() OVER w AS rank, count(*) OVER (PARTITION BY anchor_date, user_id) AS kept, lag(event_date) OVER w AS prev
 FROM (SELECT * FROM h WHERE age BETWEEN 0 AND 364 QUALIFY row_number() OVER (PARTITION BY anchor_date, user_id ORDER BY event_date DESC) <= {keep})
 WINDOW w AS (PARTITION BY anchor_date, user_id ORDER BY event_date))"""


LN = lambda c: f"ln(1 + {c})"
DOY = "dayofyear(event_date)"
SEQ_SQL = f"""SELECT anchor_date, user_id, 180 - kept + rank - 1 AS position, rank, {LN('searches')} AS c_search, {', '.join(f'{LN(c)} AS c_{c}' for c in ('cat', 'to_cart', 'to_ord', 'gmv', 'gmv_search', 'gmv_cat', 'searches'))},
 search_to_cart AS c_s2c, search_to_ord AS c_s2o, cat_to_cart AS c_c2c, cat_to_ord AS c_c2o, age / 365 AS t_norm, exp(-age / 30.0) AS t_decay,
 sin(2 * pi() * {DOY} / 365.25) AS t_sin, cos(2 * pi() * {DOY} / 365.25) AS t_cos, exp(-abs(age - 15) / 30.0) AS t_season_prox, isodow(event_date) / 7 AS t_dow,
 {', '.join(f'{flag_sql(f"age <= {d}")} AS {k}' for k, d in Q.AGE_FLAGS.items())} FROM ev"""
query("event_sequence", sql=ctes(LOG, QUARTER_CTE, HIST, events_sql(180)) + SEQ_SQL)(lambda t: Q.sequence_rows(Q.event_sequence(t.log, t.quarters)))
query("event_sequence_events", sql=ctes(CLICKS, EVENT_CTE, HIST, events_sql(180)) + SEQ_SQL)(lambda t: Q.sequence_rows(Q.event_sequence(t.clicks, t.event_anchors)))
DELTA = "CASE WHEN rank = 1 THEN 0 ELSE event_date - prev END"
MID = "dayofyear(CAST(anchor_date + 15 AS DATE))"
PAIRS = ("search_to_cart", "search_to_ord", "cat_to_cart", "cat_to_ord")
query("event_sequence_delta", sql=ctes(CLICKS, EVENT_CTE, HIST, events_sql(128)) + f"""SELECT anchor_date, user_id, 128 - kept + rank - 1 AS position, kept - rank AS rank_from_end,
 searches AS c_search, cat AS c_cat, {', '.join(f"{flag_sql(c + ' > 0')} AS c_has_{c}, {LN(c)} AS c_log_{c}" for c in PAIRS)}, {LN('gmv')} AS c_log_gmv, {flag_sql('to_ord > 0')} AS c_is_purchase_day,
 age / 365 AS age_norm, {LN('age')} / ln(366) AS log_age_norm, {DELTA} / 365 AS delta_norm, {LN(DELTA)} / ln(366) AS log_delta_norm,
 sin(2 * pi() * (isodow(event_date) - 1) / 7) AS dow_sin, cos(2 * pi() * (isodow(event_date) - 1) / 7) AS dow_cos, sin(2 * pi() * {DOY} / 365.25) AS doy_sin, cos(2 * pi() * {DOY} / 365.25) AS doy_cos,
 sin(2 * pi() * ({DOY} - {MID}) / 365.25) AS target_phase_sin, cos(2 * pi() * ({DOY} - {MID}) / 365.25) AS target_phase_cos, {flag_sql('rank = 1')} AS is_first_event FROM ev""")(
    lambda t: Q.sequence_rows(Q.event_sequence_delta(t.clicks, t.event_anchors)))
# users of fewer than four events have the first and the last slots of the padded sequence as views
VIEWS_SQL = """, v AS (SELECT *, CASE WHEN rank <= kept // 2 THEN 'early' ELSE 'late' END AS view_name,
 CASE WHEN rank <= kept // 2 THEN kept // 2 ELSE kept - kept // 2 END AS size, CASE WHEN rank <= kept // 2 THEN rank ELSE rank - kept // 2 END AS r FROM ev WHERE kept >= 4),
 few AS (SELECT anchor_date, user_id, count(rank) AS k FROM (SELECT DISTINCT anchor_date, user_id FROM h) LEFT JOIN ev USING (anchor_date, user_id) GROUP BY 1, 2 HAVING count(rank) < 4),
 slots AS (SELECT anchor_date, user_id, view_name, slot, CASE WHEN view_name = 'late' THEN slot - 31 + k END AS rank FROM few, (VALUES ('early'), ('late')) AS w(view_name), range(32) AS t(slot))
 SELECT anchor_date, user_id, view_name, r - 1 - greatest(size - 32, 0) AS slot, ln(1 + gmv) AS c_gmv FROM v WHERE r > size - 32
 UNION ALL SELECT s.anchor_date, s.user_id, view_name, slot, ln(1 + coalesce(gmv, 0)) FROM slots s LEFT JOIN ev ON ev.anchor_date = s.anchor_date AND ev.user_id = s.user_id AND ev.rank = s.rank"""


def view_rows(sequences):
    views = Q.split_views(sequences)
    # empty slots stand at the end, so the others keep their numbers
    amounts = lambda name: F.struct(F.lit(name).alias("view_name"), F.transform(F.filter(f"view_{name}", lambda e: e.isNotNull()), lambda e: e["c_gmv"]).alias("view"))
    sides = views.select("anchor_date", "user_id", F.inline(F.array(amounts("early"), amounts("late"))))
    return sides.select("anchor_date", "user_id", "view_name", F.posexplode_outer("view").alias("slot", "c_gmv")).where("slot IS NOT NULL")


VIEW_KEYS = ("anchor_date", "user_id", "view_name")
query("split_views", VIEW_KEYS, ctes(LOG, CV, HIST, events_sql(180)) + VIEWS_SQL)(lambda t: view_rows(Q.event_sequence(t.log, t.cv)))
query("split_views_events", VIEW_KEYS, ctes(CLICKS, EVENT_CTE, HIST, events_sql(180)) + VIEWS_SQL)(lambda t: view_rows(Q.event_sequence(t.clicks, t.event_anchors)))
LENGTHS_SQL = """len AS (SELECT anchor_date, user_id, count(age) AS n_events_raw, least(count(age), 128) AS n_events_retained, CASE WHEN count(age) > 128 THEN 1 ELSE 0 END AS was_truncated,
 coalesce(list_sort(list(age) FILTER (WHERE age IS NOT NULL))[least(count(age), 128)], 0) AS retained_history_span_days
 FROM (SELECT anchor_date, user_id, CASE WHEN age BETWEEN 0 AND 364 THEN age END AS age FROM h) GROUP BY 1, 2)"""
query("sequence_lengths", sql=ctes(CLICKS, EVENT_CTE, HIST, LENGTHS_SQL) + "SELECT * FROM len")(lambda t: Q.sequence_lengths(t.clicks, t.event_anchors))
query("sequence_length_audit", ("anchor_date", "transition_state"), ctes(LOG, QUARTER_CTE, HIST, LENGTHS_SQL, LABELS_SQL) + f"""SELECT anchor_date, was_active || '' || will_buy AS transition_state, count(*) AS n_samples,
 avg(n_events_raw) AS mean_events, stddev_pop(n_events_raw) AS std_events, min(n_events_raw) AS min_events, max(n_events_raw) AS max_events,
 avg({flag_sql('n_events_raw = 0')}) AS fraction_zero_events, {', '.join(f"avg({flag_sql(f'n_events_raw <= {k}')}) AS fraction_le_{k}" for k in (16, 32, 64))},
 {', '.join(f"avg({flag_sql(f'n_events_raw > {k}')}) AS fraction_gt_{k}" for k in (128, 192, 256))},
 coalesce(avg(retained_history_span_days) FILTER (WHERE n_events_raw > 0), 0) AS mean_retained_span_days,
 {', '.join(f"coalesce(avg({flag_sql(f'retained_history_span_days < {k}')}) FILTER (WHERE n_events_raw > 128), 0) AS fraction_span_lt_{k}d_when_truncated" for k in (180, 90))},
 {', '.join(f"quantile_cont(n_events_raw, {q / 100}) AS p{q:02d}_events" for q in (1, 10, 25, 50, 75, 90, 95, 99))},
 {', '.join(f"quantile_cont(retained_history_span_days, {q / 100}) FILTER (WHERE n_events_raw > 0) AS p{q}_span" for q in (10, 50, 90))}
 FROM len JOIN lab USING (anchor_date, user_id) GROUP BY 1, 2""")(
    lambda t: Q.sequence_length_audit(Q.sequence_lengths(t.log, t.quarters).join(
        L.transition_labels(L.state_labels(t.log, t.quarters)).select("anchor_date", "user_id", "transition_state"), ["anchor_date", "user_id"]),
        ["anchor_date", "transition_state"]))
