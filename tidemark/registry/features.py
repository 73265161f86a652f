"""Queries for sources, anchors, index, labels and windows."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from tidemark.operators import anchors as A
from tidemark.operators import derived as D
from tidemark.operators import index as I
from tidemark.operators import labels as L
from tidemark.operators import windows as W
from tidemark.registry.base import (
    CLICKS, CV, EVENT_CTE, HIST, LOG, PANEL_CTE, PER_USER, QUARTER_CTE, QUARTERS, clip_sql, ctes, flag_sql, n,
    query, s, since, span,
)
from tidemark.sources import activity, sinks

DAY = ("user_id", "event_date")
ANCHOR = ("anchor_date",)
USER = ("user_id",)

# --- sources and sinks ----------------------------------------------------------------------

query("read_activity_log", DAY, ctes(LOG) + "SELECT * FROM log")(lambda t: activity.normalise_log(t.log))
query("read_activity_log_events", DAY, ctes(CLICKS) + "SELECT * FROM log")(lambda t: activity.normalise_log(t.clicks))
query("read_users_lazy", USER, "SELECT DISTINCT o_custkey AS user_id FROM orders")(lambda t: activity.read_users(
    t.read("orders").select(F.col("o_custkey").alias("user_id"))))


def scratch(t, name: str) -> str:
    """A new folder beside the shared checkpoint folder of the cluster, or a temporary one in local tests."""
    shared = t.spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not t.spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if shared:
        return f"{shared.rstrip('/')}/{name}-{t.spark.sparkContext.applicationId}-{os.urandom(4).hex()}"
    return os.path.join(tempfile.mkdtemp(prefix="tidemark-"), name)


def fold_table(t):
    """Labelled folds (numbered from the oldest anchor) and the unlabelled final fold."""
    cv = t.cv
    final = t.log.agg(F.max("event_date").alias("anchor_date"))
    targets = L.future_sum_target(t.log, cv)
    feats = W.fold_features(t.log, cv.unionByName(final))
    number = cv.agg(F.array_sort(F.collect_set("anchor_date")).alias("_all"))  # four anchors
    named = feats.crossJoin(F.broadcast(number)).withColumn(
        "fold", F.when(F.array_contains("_all", F.col("anchor_date")), F.concat(
            F.lit("fold_"), F.lpad((F.array_position("_all", F.col("anchor_date")) - 1).cast("string"), 2, "0"))).otherwise("fold_end"))
    return named.drop("_all").join(targets, ["anchor_date", "user_id"], "left")


FOLDS_SQL = ctes(LOG, CV, HIST) + f""", f AS (SELECT anchor_date, user_id, {s('gmv', 0, 29)} AS gmv_sum_30d,
 {s('gmv', -30, -1)} AS target {PER_USER})
SELECT anchor_date, user_id, 'fold_' || lpad(CAST(dense_rank() OVER (ORDER BY anchor_date) - 1 AS VARCHAR), 2, '0') AS fold,
 gmv_sum_30d, target FROM f
UNION ALL SELECT m.d, u.user_id, 'fold_end', coalesce(sum(gmv), 0), NULL FROM u CROSS JOIN (SELECT max(event_date) AS d FROM log) m
 LEFT JOIN log l ON l.user_id = u.user_id AND l.event_date > m.d - 30 GROUP BY m.d, u.user_id"""


@query("write_folds", ("anchor_date", "user_id", "fold"), FOLDS_SQL)
def _(t):
    path = scratch(t, "folds")
    sinks.write_folds(fold_table(t), path)
    return t.spark.read.parquet(path).select("anchor_date", "user_id", "fold", "gmv_sum_30d", "target")


@query("read_fold", ("anchor_date", "user_id", "fold"), ctes(LOG, CV, HIST) + f"""SELECT anchor_date, user_id, 'fold_03' AS fold,
 {s('gmv', 0, 29)} AS gmv_sum_30d, {s('gmv', -30, -1)} AS target FROM h WHERE anchor_date = (SELECT max(anchor_date) FROM a)
 GROUP BY anchor_date, user_id""")
def _(t):
    path = scratch(t, "folds")
    sinks.write_folds(fold_table(t).select("anchor_date", "user_id", "fold", "gmv_sum_30d", "target"), path)
    return activity.read_fold(t.spark, path, "fold_03")


def template(t):
    return I.user_id_index(t.users).select("user_id", F.col("user_idx").alias("position"))


TEMPLATE_SQL = "tpl AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS position FROM (SELECT DISTINCT user_id FROM log))"


@query("read_template", USER, ctes(LOG, TEMPLATE_SQL) + "SELECT user_id, position FROM tpl")
def _(t):
    path = scratch(t, "template")
    template(t).write.csv(path, header=True)
    return activity.read_template(t.spark, path)


@query("write_snapshots", sql=ctes(LOG, CV, HIST) + f"SELECT anchor_date, user_id, {s('gmv', 0, 29)} AS gmv_sum_30d {PER_USER}")
def _(t):
    path = scratch(t, "snapshots")
    sinks.write_snapshots(W.window_aggs(t.log, t.cv), path)
    return t.spark.read.parquet(path).select("anchor_date", "user_id", "gmv_sum_30d")


@query("read_columns", sql=ctes(LOG, CV, HIST) + f"SELECT anchor_date, user_id, {s('to_ord', 0, 89)} AS to_ord_sum_90d {PER_USER}")
def _(t):
    path = scratch(t, "snapshots")
    sinks.write_snapshots(W.window_aggs(t.log, t.cv), path)
    return activity.read_columns(t.spark, path, ["to_ord_sum_90d"])


@query("write_no_overwrite", ("refused",), "SELECT true AS refused, count(DISTINCT o_custkey) AS n FROM orders")
def _(t):
    path = scratch(t, "root")
    sinks.write_no_overwrite(t.users, path)
    try:
        sinks.write_no_overwrite(t.users, path)
        refused = False
    except Exception as error:  # noqa: BLE001 - the kind of error is checked on the next line
        refused = "PATH_ALREADY_EXISTS" in str(error)
    return t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select(F.lit(refused).alias("refused"), "n")


@query("write_predictions_csv", USER, ctes(LOG) +
       "SELECT user_id, coalesce(sum(gmv) FILTER (WHERE event_date > (SELECT max(event_date) FROM log) - 30), 0) AS predict FROM log GROUP BY user_id")
def _(t):
    path = scratch(t, "submission")
    last = t.log.agg(F.max("event_date").alias("anchor_date"))
    naive = W.window_aggs(t.log, last, windows={"30d": (29, 0)}, metrics=["gmv"], aggs=["sum"])
    ordered = I.join_template_ordered(template(t), naive.select("user_id", F.col("gmv_sum_30d").alias("predict")), "predict")
    sinks.write_predictions_csv(ordered, path)
    return t.spark.read.csv(path, header=True, schema="user_id long, predict double")


@query("write_oof", ("fold", "user_id"), ctes(LOG, CV, HIST) + f"""SELECT 'fold_' || CAST(row_number() OVER (PARTITION BY user_id ORDER BY anchor_date DESC) - 1
 AS VARCHAR) AS fold, user_id, ln(1 + {s('gmv', 0, 29)}) AS prediction_z {PER_USER}""")
def _(t):
    path = scratch(t, "oof")
    feats = W.window_aggs(t.log, t.cv, windows={"30d": (29, 0)}, metrics=["gmv"], aggs=["sum"])
    last = t.log.agg(F.max("event_date").alias("_last"))
    number = F.floor((F.date_diff("_last", "anchor_date") - 30) / 14)
    scored = feats.crossJoin(F.broadcast(last)).select(number.cast("int").alias("_i"), "user_id", F.log1p("gmv_sum_30d").alias("prediction_z"))
    sinks.write_oof([scored.where(F.col("_i") == i).select(F.lit(f"fold_{i}").alias("fold"), "user_id", "prediction_z") for i in range(4)], path)
    return t.spark.read.parquet(path).select("fold", "user_id", "prediction_z")


# --- anchors and time splits ----------------------------------------------------------------

query("cv_anchors", ANCHOR, ctes(LOG, CV) + "SELECT anchor_date FROM a")(lambda t: t.cv)
query("panel_anchors", ANCHOR, ctes(LOG, PANEL_CTE) + "SELECT anchor_date FROM a")(lambda t: t.panel)
query("calendar_anchors", ANCHOR, ctes(LOG) + """SELECT DISTINCT d AS anchor_date FROM (
 SELECT CAST(first + 30 + 14 * CAST(i AS INT) AS DATE) AS d, last FROM (SELECT min(event_date) AS first, max(event_date) AS last FROM log), range(1000) AS t(i)
 UNION ALL SELECT DATE '1999-02-13', max(event_date) FROM log
 UNION ALL SELECT CAST(max(event_date) - 30 AS DATE), max(event_date) FROM log) WHERE d <= last - 30""")(
    lambda t: A.calendar_anchors(t.log, extra=["1999-02-13"]))
PAIRS = "pairs AS (SELECT v.anchor_date AS valid_anchor, t.anchor_date AS train_anchor FROM a v JOIN a t ON t.anchor_date + 30 <= v.anchor_date)"
query("purged_train_anchors", ("valid_anchor", "train_anchor"), ctes(LOG, PANEL_CTE, PAIRS) + "SELECT * FROM pairs")(
    lambda t: A.purged_train_anchors(t.panel))
query("purged_train_anchors_newest", ("valid_anchor", "train_anchor"), ctes(LOG, PANEL_CTE, PAIRS) +
      "SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY valid_anchor ORDER BY train_anchor DESC) <= 3")(
    lambda t: A.purged_train_anchors(t.panel, newest=3))


@query("expanding_folds", ("fold_id", "outer_anchor", "inner_valid_anchor", "train_list", "inner_list"), ctes(LOG, PANEL_CTE, PAIRS) + """,
l AS (SELECT a.anchor_date AS outer_anchor, list(train_anchor ORDER BY train_anchor) FILTER (WHERE train_anchor IS NOT NULL) AS tr
  FROM a LEFT JOIN pairs ON valid_anchor = a.anchor_date GROUP BY 1),
f AS (SELECT 'fold_' || lpad(CAST(row_number() OVER (ORDER BY outer_anchor) - 1 AS VARCHAR), 2, '0') AS fold_id, outer_anchor,
  coalesce(list_max(tr), outer_anchor) AS inner_valid_anchor, coalesce(tr, []) AS tr FROM l)
SELECT fold_id, outer_anchor, inner_valid_anchor, array_to_string(tr, ',') AS train_list,
  array_to_string(list_filter(tr, lambda x: x + 30 <= inner_valid_anchor), ',') AS inner_list, len(tr) AS n_train_anchors
FROM f WHERE len(tr) >= 5 OR fold_id = 'fold_00'""")
def _(t):
    folds = A.expanding_folds(t.panel, t.panel)
    text = lambda c: F.concat_ws(",", F.transform(c, lambda d: d.cast("string")))
    return folds.select("fold_id", "outer_anchor", "inner_valid_anchor", text("train_anchors").alias("train_list"),
                        text("inner_train_anchors").alias("inner_list"), "n_train_anchors")


query("paired_folds", ("train_anchor", "train_target_start", "train_target_end", "inference_anchor", "validation_target_start", "validation_target_end"),
      ctes(LOG, CV) + """SELECT CAST(anchor_date - 30 AS DATE) AS train_anchor, CAST(anchor_date - 29 AS DATE) AS train_target_start,
 anchor_date AS train_target_end, anchor_date AS inference_anchor, CAST(anchor_date + 1 AS DATE) AS validation_target_start,
 CAST(anchor_date + 30 AS DATE) AS validation_target_end FROM a""")(lambda t: A.paired_folds(t.cv))
query("two_run_pairs", ("meta_anchor", "validation_anchor"), ctes(LOG, PANEL_CTE, PAIRS) +
      "SELECT train_anchor AS meta_anchor, valid_anchor AS validation_anchor FROM pairs")(lambda t: A.two_run_pairs(t.panel))
WINDOW_DATES = ["state_history_start", "state_history_end", "model_target_start", "model_target_end", "short_history_start", "long_history_start"]
WINDOWS_SQL = """CAST(anchor_date - 89 AS DATE) AS state_history_start, anchor_date AS state_history_end,
 CAST(anchor_date + 1 AS DATE) AS model_target_start, CAST(anchor_date + 30 AS DATE) AS model_target_end,
 CAST(anchor_date - 179 AS DATE) AS short_history_start, CAST(anchor_date - 364 AS DATE) AS long_history_start"""
query("split_windows", ("anchor_date", *WINDOW_DATES), ctes(LOG, PANEL_CTE) + f"SELECT anchor_date, {WINDOWS_SQL} FROM a")(
    lambda t: A.split_windows(t.panel))


@query("two_run_profile", ("run", "role", "anchor_date", *WINDOW_DATES), ctes(LOG, PANEL_CTE) + f""", m AS (SELECT max(anchor_date) AS v,
 max(anchor_date) FILTER (WHERE anchor_date + 30 <= (SELECT max(anchor_date) FROM a)) AS m FROM a),
 r AS (SELECT 'RUN_A' AS run, m AS holdout FROM m UNION ALL SELECT 'RUN_B', v FROM m)
 SELECT run, CASE WHEN anchor_date = holdout THEN 'holdout' ELSE 'train' END AS role, anchor_date, {WINDOWS_SQL} FROM a, r
 WHERE anchor_date + 30 <= holdout OR anchor_date = holdout""")
def _(t):
    last = t.panel.agg(F.max("anchor_date").alias("_v"))
    meta = t.panel.crossJoin(F.broadcast(last)).where(F.date_add("anchor_date", 30) <= F.col("_v")).groupBy("_v").agg(F.max("anchor_date").alias("_m"))
    row = meta.first()  # two dates
    return A.two_run_profile(t.panel, F.lit(row["_m"]), F.lit(row["_v"]))


query("check_fold_safety", ("valid_anchor", "train_anchor", "train_target_end"), ctes(LOG, PANEL_CTE) + """SELECT v.anchor_date AS valid_anchor,
 t.anchor_date AS train_anchor, CAST(t.anchor_date + 30 AS DATE) AS train_target_end, CAST(t.anchor_date + 30 - v.anchor_date AS INT) AS days_over
 FROM a v JOIN a t ON t.anchor_date <= v.anchor_date WHERE t.anchor_date + 30 > v.anchor_date""")(
    lambda t: A.check_fold_safety(A.purged_train_anchors(t.panel, horizon=0)))


@query("anchor_edge_audit", ("anchor_date", "input_start", "input_end", "target_start", "target_end"), ctes(LOG, CV, HIST) + f""",
y AS (SELECT anchor_date, user_id, {s('gmv', -30, -1)} AS target {PER_USER}), v AS (SELECT max(anchor_date) AS v FROM a)
SELECT anchor_date, count(*) AS n_users, avg(CASE WHEN target = 0 THEN 1.0 ELSE 0 END) AS target_zero_rate, avg(target) AS mean_target,
 quantile_cont(target, .5) AS p50_target, quantile_cont(target, .9) AS p90_target, quantile_cont(target, .99) AS p99_target,
 CAST(anchor_date - 364 AS DATE) AS input_start, anchor_date AS input_end, CAST(anchor_date + 1 AS DATE) AS target_start,
 CAST(anchor_date + 30 AS DATE) AS target_end,
 CASE WHEN anchor_date = any_value(v) THEN 0 ELSE greatest(0, CAST(anchor_date + 30 - (any_value(v) + 1) AS INT) + 1) END AS overlap_days_with_valid
FROM y, v GROUP BY anchor_date""")
def _(t):
    last = t.cv.agg(F.max("anchor_date").alias("v")).first()["v"]
    return A.anchor_edge_audit(L.future_sum_target(t.log, t.cv), F.lit(last))


query("anchor_weights", ANCHOR, ctes(LOG, PANEL_CTE) + """SELECT anchor_date, CASE WHEN anchor_date >= DATE '2001-01-01' THEN 2.5
 WHEN anchor_date >= DATE '2000-01-01' THEN 1.5 ELSE 1.0 END AS weight FROM a""")(
    lambda t: A.anchor_weights(t.panel, "2000-01-01", "2001-01-01"))
query("load_purged_panel", ("anchor_date", "user_id", "role"), ctes(LOG, QUARTER_CTE, HIST) + f"""SELECT anchor_date, user_id,
 CASE WHEN anchor_date = DATE '2001-01-01' THEN 'valid' ELSE 'train' END AS role, {s('gmv', -30, -1)} AS target
 FROM h WHERE anchor_date + 30 <= DATE '2001-01-01' OR anchor_date = DATE '2001-01-01' GROUP BY anchor_date, user_id""")(
    lambda t: A.load_purged_panel(L.future_sum_target(t.log, t.quarters), t.quarters, "2001-01-01"))

# --- calendar -------------------------------------------------------------------------------


def next_sql(d: str, month: int, day: int) -> str:
    here = f"make_date(CAST(year({d}) AS INT), {month}, {day})"
    return f"CASE WHEN {here} >= {d} THEN {here} ELSE make_date(CAST(year({d}) AS INT) + 1, {month}, {day}) END"


HOLIDAY_SQL = "hol AS (SELECT make_date(CAST(y AS INT), m, d) AS holiday, m FROM range(1990, 2010) AS r(y), (VALUES (1, 1), (2, 23), (3, 8), (11, 11)) AS v(m, d))"
query("holiday_distance", ANCHOR, ctes(LOG, PANEL_CTE, HOLIDAY_SQL) + f"""SELECT anchor_date,
 {', '.join(f"{next_sql('anchor_date', m, d)} - anchor_date AS days_to_{k}" for k, (m, d) in A.DISTANCE_HOLIDAYS.items())},
 (SELECT {flag_sql('count(*) > 0')} FROM hol WHERE holiday BETWEEN anchor_date + 1 AND anchor_date + 30) AS target_window_covers_holiday FROM a""")(
    lambda t: A.holiday_distance(t.panel))
CALENDAR_SQL = """cal AS (SELECT anchor_date,
 max(CASE WHEN inside AND m = 1 THEN 1 ELSE 0 END) AS target_contains_new_year, max(CASE WHEN inside AND m = 2 THEN 1 ELSE 0 END) AS target_contains_feb23,
 max(CASE WHEN inside AND m = 3 THEN 1 ELSE 0 END) AS target_contains_mar8, max(CASE WHEN inside AND m = 11 THEN 1 ELSE 0 END) AS target_contains_black_friday,
 max(CASE WHEN inside THEN 1 ELSE 0 END) AS target_contains_any_holiday, count(*) FILTER (WHERE inside) AS number_of_holidays_in_target,
 min(holiday - anchor_date) FILTER (WHERE holiday >= anchor_date) AS days_to_nearest_holiday,
 month(anchor_date) AS anchor_month, isodow(anchor_date) - 1 AS anchor_day_of_week, dayofyear(anchor_date) AS anchor_day_of_year,
 dayofyear(CAST(anchor_date + 1 AS DATE)) AS target_start_doy, dayofyear(CAST(anchor_date + 15 AS DATE)) AS target_midpoint_doy,
 dayofyear(CAST(anchor_date + 30 AS DATE)) AS target_end_doy,
 sin(2 * pi() * dayofyear(CAST(anchor_date + 15 AS DATE)) / 365.25) AS sin_doy, cos(2 * pi() * dayofyear(CAST(anchor_date + 15 AS DATE)) / 365.25) AS cos_doy
 FROM (SELECT *, holiday BETWEEN anchor_date + 1 AND anchor_date + 30 AS inside FROM a, hol) GROUP BY anchor_date)"""
query("target_calendar", ANCHOR, ctes(LOG, PANEL_CTE, HOLIDAY_SQL, CALENDAR_SQL) + "SELECT * FROM cal")(
    lambda t: A.target_calendar(t.panel, A.holiday_table(t.panel)))
PUBLIC_SQL = "pub AS (SELECT * FROM (VALUES " + ", ".join(f"({m}, {d})" for m, d in A.PUBLIC_HOLIDAYS) + ") AS v(m, d))"
CONTEXT_SQL = """ctx AS (SELECT anchor_date, count(*) FILTER (WHERE isodow(day) >= 6) AS cal_weekends_in_target_window,
 count(*) FILTER (WHERE (month(day), day(day)) IN (SELECT (m, d) FROM pub)) AS cal_holiday_days_in_target_window,
 month(anchor_date) AS cal_anchor_month, sin(2 * pi() * dayofyear(anchor_date) / 365.25) AS cal_anchor_doy_sin,
 cos(2 * pi() * dayofyear(anchor_date) / 365.25) AS cal_anchor_doy_cos,
 (SELECT min(make_date(CAST(year(anchor_date) AS INT) + k, m, d) - anchor_date) FROM pub, (VALUES (0), (1)) AS z(k)
   WHERE make_date(CAST(year(anchor_date) AS INT) + k, m, d) >= anchor_date) AS cal_days_to_nearest_holiday
 FROM (SELECT anchor_date, CAST(anchor_date + CAST(i AS INT) AS DATE) AS day FROM a, range(1, 31) AS t(i)) GROUP BY anchor_date)"""
query("calendar_context", ANCHOR, ctes(LOG, PANEL_CTE, PUBLIC_SQL, CONTEXT_SQL) + "SELECT * FROM ctx")(lambda t: A.calendar_context(t.panel))
query("technical_columns", ("anchor_date", "history_start", "history_end", "target_start", "target_end"), ctes(LOG, PANEL_CTE) + """SELECT anchor_date,
 CAST(anchor_date - 89 AS DATE) AS history_start, anchor_date AS history_end, CAST(anchor_date + 1 AS DATE) AS target_start,
 CAST(anchor_date + 30 AS DATE) AS target_end, least(90, anchor_date - DATE '1995-02-01' + 1) AS available_history_days FROM a""")(
    lambda t: A.technical_columns(t.panel, data_start="1995-02-01"))

# --- index and cohorts ----------------------------------------------------------------------

query("anchor_user_index", sql=ctes(LOG, CV) + "SELECT anchor_date, user_id FROM a, (SELECT DISTINCT user_id FROM log)")(
    lambda t: I.anchor_user_index(t.cv, t.users))
query("align_to_index", sql=ctes(LOG, QUARTER_CTE, HIST) + f"SELECT anchor_date, user_id, {s('gmv', 0, 29)} AS gmv_sum, {since('true', 29, '999')} AS days_since_last_activity {PER_USER}")(
    lambda t: I.align_to_index(I.anchor_user_index(t.quarters, t.users), t.log.join(
        F.broadcast(t.quarters), F.date_diff("anchor_date", "event_date").between(0, 29)).groupBy("anchor_date", "user_id").agg(
        F.sum("gmv").alias("gmv_sum"), F.min(F.date_diff("anchor_date", "event_date")).alias("days_since_last_activity"))))
query("filter_users", DAY, ctes(LOG) + "SELECT user_id, event_date, gmv FROM log WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")(
    lambda t: I.filter_users(t.log, t.read("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))).select(
        "user_id", "event_date", "gmv"))
query("sample_users", USER, ctes(LOG) + """SELECT user_id FROM (SELECT DISTINCT user_id FROM log)
 QUALIFY row_number() OVER (ORDER BY sha256('42|' || user_id), user_id) <= 100""")(lambda t: I.sample_users(t.users, 100))
STATES = f"""st AS (SELECT user_id, {flag_sql(s('gmv', 0, 89) + ' > 0')} || '' || {flag_sql(s('gmv', -30, -1) + ' > 0')} AS stratum
 FROM h WHERE anchor_date = DATE '2000-01-01' GROUP BY user_id)"""


def cohort_cte(name: str, source: str, total: int) -> str:
    return f"""q_{name} AS (SELECT stratum, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= {total} - sum(base) OVER () THEN 1 ELSE 0 END AS quota
 FROM (SELECT stratum, floor(count(*) * {total} / sum(count(*)) OVER ()) AS base,
  count(*) * {total} / sum(count(*)) OVER () - floor(count(*) * {total} / sum(count(*)) OVER ()) AS rest FROM st GROUP BY 1)),
 {name} AS (SELECT user_id, stratum FROM (SELECT c.user_id, c.stratum, quota, row_number() OVER (PARTITION BY c.stratum
  ORDER BY sha256('42|quarter|{name}|' || c.stratum || '|' || c.user_id), c.user_id) AS r FROM {source} c JOIN q_{name} USING (stratum)) WHERE r <= quota)"""


def states(t):
    one = A.anchor_table(t.spark, ["2000-01-01"])
    return L.transition_labels(L.state_labels(t.log, one)).select("user_id", F.col("transition_state").alias("stratum"))


@query("stratified_cohort", ("user_id", "stratum"),
       ctes(LOG, QUARTER_CTE, HIST, STATES, cohort_cte("wide", "st", 120), cohort_cte("screen", "wide", 40)) +
       "SELECT user_id, stratum, CASE WHEN user_id IN (SELECT user_id FROM screen) THEN 1 ELSE 0 END AS in_screen FROM wide")
def _(t):
    universe = states(t)
    wide = I.stratified_cohort(universe, 120, "quarter", "wide")
    screen = I.stratified_cohort(wide, 40, "quarter", "screen", quota_source=universe)
    return wide.join(screen.select("user_id", F.lit(1).alias("in_screen")), "user_id", "left").select(
        "user_id", "stratum", F.coalesce("in_screen", F.lit(0)).alias("in_screen"))


@query("cohort_manifest", ("cohort", "stratum"), ctes(LOG, QUARTER_CTE, HIST, STATES, cohort_cte("wide", "st", 120)) + """,
 c AS (SELECT 'universe' AS cohort, stratum FROM st UNION ALL SELECT 'wide', stratum FROM wide)
 SELECT cohort, stratum, count(*) AS n_users, count(*) / sum(count(*)) OVER (PARTITION BY cohort) AS share FROM c GROUP BY 1, 2""")
def _(t):
    universe = states(t)
    return I.cohort_manifest({"universe": universe, "wide": I.stratified_cohort(universe, 120, "quarter", "wide")})


query("balanced_sample", ("user_id", "stratum"), ctes(LOG, QUARTER_CTE, HIST, STATES) +
      "SELECT user_id, stratum FROM st QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY user_id) <= 5")(
    lambda t: I.balanced_sample(states(t), 5, "stratum", "user_id"))
query("user_id_index", USER, ctes(LOG) + "SELECT user_id, row_number() OVER (ORDER BY user_id) AS user_idx FROM (SELECT DISTINCT user_id FROM log)")(
    lambda t: I.user_id_index(t.users))


@query("check_alignment", (), ctes(LOG) + """, l AS (SELECT user_id, sum(gmv) AS x FROM log GROUP BY 1),
 r AS (SELECT c_custkey AS user_id, coalesce((SELECT sum(gmv) FROM log WHERE user_id = c_custkey AND to_ord < 3), 0) AS x FROM customer)
 SELECT 0 AS duplicates_left, 0 AS duplicates_right, count(*) FILTER (WHERE r.user_id IS NULL) AS missing_right,
 count(*) FILTER (WHERE l.user_id IS NULL) AS missing_left, count(*) FILTER (WHERE abs(l.x - r.x) > 0.001) AS different_x
 FROM l FULL JOIN r ON l.user_id = r.user_id""")
def _(t):
    cents = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 2).alias("x")
    left = t.log.groupBy("user_id").agg(cents(F.sum("gmv")))
    right = t.read("customer").select(F.col("c_custkey").alias("user_id")).join(
        t.log.where("to_ord < 3").groupBy("user_id").agg(F.sum("gmv").alias("g")), "user_id", "left").select("user_id", cents(F.col("g")))
    return I.check_alignment(left, right, ["user_id"], ["x"])


query("join_template_ordered", USER, ctes(LOG) + "SELECT user_id, row_number() OVER (ORDER BY user_id) AS position, sum(gmv) AS predict FROM log GROUP BY user_id")(
    lambda t: I.join_template_ordered(template(t), t.log.groupBy("user_id").agg(F.sum("gmv").alias("predict")), "predict"))
query("append_channel", sql=ctes(LOG, QUARTER_CTE, HIST) + f"SELECT anchor_date, user_id, {s('gmv', 0, 29)} AS base_z, {s('gmv', 0, 89)} AS new_a, {s('to_ord', 0, 89)} AS new_b {PER_USER}")(
    lambda t: I.append_channel(
        W.window_aggs(t.log, t.quarters).select("anchor_date", "user_id", F.col("gmv_sum_30d").alias("base_z"), F.lit(0.0).alias("new_a"), F.lit(0.0).alias("new_b")),
        W.window_aggs(t.log, t.quarters).select("anchor_date", "user_id", F.col("gmv_sum_90d").alias("new_a"), F.col("to_ord_sum_90d").alias("new_b")),
        ["new_a", "new_b"]))
query("union_panel", ("source", "user_id"), ctes(LOG) + "SELECT 'amount' AS source, user_id, sum(gmv) AS gmv, NULL AS orders FROM log GROUP BY user_id "
      "UNION ALL SELECT 'count', user_id, NULL, sum(to_ord) FROM log GROUP BY user_id")(
    lambda t: I.union_panel([
        t.log.groupBy("user_id").agg(F.sum("gmv").alias("gmv")).withColumn("source", F.lit("amount")),
        t.log.groupBy("user_id").agg(F.sum("to_ord").alias("orders")).withColumn("source", F.lit("count"))]))

# --- labels ---------------------------------------------------------------------------------

query("future_sum_target", sql=ctes(LOG, QUARTER_CTE, HIST) + f"SELECT anchor_date, user_id, {s('gmv', -30, -1)} AS target {PER_USER}")(
    lambda t: L.future_sum_target(t.log, t.quarters))
query("log_target", USER, ctes(LOG) + "SELECT user_id, ln(1 + coalesce(sum(gmv) FILTER (WHERE event_date BETWEEN DATE '2000-01-02' AND DATE '2000-01-31'), 0)) AS target_z FROM log GROUP BY user_id")(
    lambda t: L.log_target(t.log, "2000-01-02", "2000-01-31"))
HORIZON_SQL = ", ".join(f"{s('gmv', -h, -1)} AS future_gmv_{h}d, ln(1 + {s('gmv', -h, -1)}) AS z_target_{h}d, {flag_sql(s('gmv', -h, -1) + ' > 0')} AS will_buy_{h}d" for h in (7, 14, 30))
query("multi_horizon_targets", sql=ctes(LOG, QUARTER_CTE, HIST) + f"SELECT anchor_date, user_id, {HORIZON_SQL} {PER_USER}")(
    lambda t: L.multi_horizon_targets(t.log, t.quarters))
query("first_purchase_interval", sql=ctes(LOG, QUARTER_CTE, HIST) + f"""SELECT anchor_date, user_id, CASE
 {' '.join(f"WHEN {s('gmv', -h, -1)} > 0 THEN {i}" for i, h in enumerate((7, 14, 21, 30)))} ELSE -1 END AS hazard_interval {PER_USER}""")(
    lambda t: L.first_purchase_interval(t.log, t.quarters))
LABELS_SQL = f"""lab AS (SELECT *, {flag_sql('past_gmv_90d > 0')} AS was_active, {flag_sql('future_gmv_30d > 0')} AS will_buy, ln(1 + future_gmv_30d) AS z_target
 FROM (SELECT anchor_date, user_id, {s('gmv', 0, 89)} AS past_gmv_90d, {s('gmv', -30, -1)} AS future_gmv_30d {PER_USER}))"""
query("state_labels", sql=ctes(LOG, QUARTER_CTE, HIST, LABELS_SQL) + "SELECT * FROM lab")(lambda t: L.state_labels(t.log, t.quarters))
query("transition_labels", ("anchor_date", "user_id", "transition_state"), ctes(LOG, QUARTER_CTE, HIST, LABELS_SQL) + """SELECT *, was_active * 2 + will_buy AS transition_id,
 was_active || '' || will_buy AS transition_state, CASE WHEN was_active = 0 THEN will_buy END AS y_reactivation,
 CASE WHEN was_active = 1 THEN 1 - will_buy END AS y_churn FROM lab""")(lambda t: L.transition_labels(L.state_labels(t.log, t.quarters)))
SPECIAL_SQL = """m AS (SELECT user_id, anchor_date, lifetime AS past_amount, future AS future_amount, ln(1 + future) AS target_z,
 CASE WHEN lifetime > 0 THEN 1 ELSE 0 END AS was_active, CASE WHEN future > 0 THEN 1 ELSE 0 END AS will_buy,
 CASE WHEN anchor_date = DATE '2001-04-01' THEN 'validation' ELSE 'train' END AS source_anchor_set FROM
 (SELECT anchor_date, user_id, coalesce(sum(gmv) FILTER (WHERE age BETWEEN 0 AND 89), 0) AS lifetime,
  coalesce(sum(gmv) FILTER (WHERE age BETWEEN -30 AND -1), 0) AS future FROM h GROUP BY 1, 2))"""


@query("specialist_datasets", ("anchor_date", "user_id", "dataset", "transition_state", "source_anchor_set"), ctes(LOG, QUARTER_CTE, HIST, SPECIAL_SQL) + """
 SELECT anchor_date, user_id, dataset, was_active || '' || will_buy AS transition_state, source_anchor_set, past_amount, future_amount, target_z
 FROM m, (VALUES ('reactivation'), ('churn'), ('amount')) AS d(dataset)
 WHERE (dataset = 'reactivation' AND was_active = 0) OR (dataset = 'churn' AND was_active = 1) OR (dataset = 'amount' AND future_amount > 0)""")
def _(t):
    m = L.specialist_manifest(L.state_labels(t.log, t.quarters), "2001-04-01", "past_gmv_90d", "future_gmv_30d")
    parts = [df.withColumn("dataset", F.lit(name)) for name, df in L.specialist_datasets(m).items()]
    return I.union_panel(parts).select("anchor_date", "user_id", "dataset", "transition_state", "source_anchor_set", "past_amount", "future_amount", "target_z")


query("binary_target", sql=ctes(LOG, QUARTER_CTE, HIST) + f"SELECT anchor_date, user_id, {s('gmv', -30, -1)} AS target, {flag_sql(s('gmv', -30, -1) + ' > 0')} AS will_buy_30d {PER_USER}")(
    lambda t: L.binary_target(L.future_sum_target(t.log, t.quarters)))

# --- windows --------------------------------------------------------------------------------

FOLD_AGG_SQL = ", ".join(
    f"{ {'sum': s(m, lo, hi), 'max': f'max({m}) FILTER (WHERE {span(lo, hi)})', 'std': f'stddev_samp({m}) FILTER (WHERE {span(lo, hi)})', 'mean': f'avg({m}) FILTER (WHERE {span(lo, hi)})'}[g]} AS {m}_{g}_{w}"
    for w, (hi, lo) in W.FOLD_WINDOWS.items() for m in W.FOLD_METRICS for g in W.FOLD_AGGS)
query("window_aggs", sql=ctes(LOG, CV, HIST) + f"SELECT anchor_date, user_id, {FOLD_AGG_SQL} {PER_USER}")(lambda t: W.window_aggs(t.log, t.cv))
ACT = "(searches > 0 OR to_cart > 0 OR to_ord > 0 OR gmv > 0)"
ACT_CAT = "(searches > 0 OR to_cart > 0 OR to_ord > 0 OR gmv > 0 OR cat > 0)"
BUY = "(to_ord > 0 OR gmv > 0)"


def activity_sql(days) -> str:
    out = []
    for d in days:
        out += [f"{n(0, d - 1, c)} AS {k}_days_{d}d" for k, c in {"active": ACT, "purchase": BUY, "search": "searches > 0", "cart": "to_cart > 0"}.items()]
        for m in W.SNAPSHOT_METRICS:
            total = s(m, 0, d - 1)
            out += [f"{total} AS {m}_sum_{d}d", f"{total} / {d}.0 AS {m}_mean_cal_{d}d", f"{total} / ({n(0, d - 1, m + ' > 0')} + 1e-5) AS {m}_mean_act_{d}d",
                    f"coalesce(max({m}) FILTER (WHERE {span(0, d - 1)}), 0) AS {m}_max_{d}d",
                    f"coalesce(stddev_samp({m}) FILTER (WHERE {span(0, d - 1)}), 0) AS {m}_std_cal_{d}d"]
    return ", ".join(out)


ACTIVITY_SQL = activity_sql((7, 14, 30, 60, 90))
query("window_activity", sql=ctes(LOG, CV, HIST) + f"SELECT anchor_date, user_id, {ACTIVITY_SQL} {PER_USER}")(lambda t: W.window_activity(t.log, t.cv))
query("window_activity_events", sql=ctes(CLICKS, EVENT_CTE, HIST) + f"SELECT anchor_date, user_id, {activity_sql((3, 7, 14))} {PER_USER}")(
    lambda t: W.window_activity(t.clicks, t.event_anchors, days=(3, 7, 14)))
SPARSE_SQL = ", ".join(
    ", ".join([f"{n(0, d - 1, c)} AS {k}_days_{d}d" for k, c in {"active": ACT_CAT, "order": BUY, "cart": "to_cart > 0", "cat": "cat > 0"}.items()]
              + [f"{s(m, 0, d - 1)} AS {name}_sum_{d}d" for m, name in W.SPARSE_METRICS.items()]) for d in W.SPARSE_DAYS)
query("sparse_window_sums", sql=ctes(LOG, QUARTER_CTE, HIST) + f"SELECT anchor_date, user_id, {SPARSE_SQL} {PER_USER}")(lambda t: W.sparse_window_sums(t.log, t.quarters))
DIRECT_SQL = ", ".join(
    ", ".join([f"{s(m, 0, d - 1)} AS direct_{m}_sum_{d}d" for m in W.DIRECT_METRICS]
              + [f"{n(0, d - 1, c)} AS direct_{k}_days_{d}d" for k, c in {"active": ACT, "order": "to_ord > 0", "cart": "to_cart > 0", "search": "searches > 0"}.items()])
    for d in W.SPARSE_DAYS) + f""", coalesce(max(age) FILTER (WHERE {span(0, 364)}), 366) AS direct_history_age_days, {n(0, 364, ACT)} AS direct_lifetime_active_days,
 {since('true', 364, '366')} AS direct_days_since_activity, {since('to_ord > 0', 364, '366')} AS direct_days_since_order,
 {since('gmv > 0', 364, '366')} AS direct_days_since_positive_gmv"""
query("direct_window_sums", sql=ctes(LOG, QUARTER_CTE, HIST) + f"SELECT anchor_date, user_id, {DIRECT_SQL} {PER_USER}")(lambda t: W.direct_window_sums(t.log, t.quarters))


def recency_sql(hi: int, other: str = "999") -> str:
    conds = {"activity": "true", "search": "searches > 0", "cart": "to_cart > 0", "order": "to_ord > 0"}
    return ", ".join(f"{since(c, hi, other)} AS days_since_last_{k}" for k, c in conds.items())


FOLD_RECENCY_SQL = f"{recency_sql(89)}, {since('gmv > 0', 89, '999')} AS days_since_last_positive_gmv, {n(0, 29)} AS active_days_30d, {n(0, 89)} AS active_days_90d"
query("recency", sql=ctes(LOG, QUARTER_CTE, HIST) + f"SELECT anchor_date, user_id, {FOLD_RECENCY_SQL} {PER_USER}")(lambda t: W.recency(t.log, t.quarters))


def lifetime_sql(hi: int) -> str:
    return f"""coalesce(max(age) FILTER (WHERE {span(0, hi)}), 999) AS customer_age_days, {recency_sql(hi)},
 {flag_sql(n(0, hi, 'to_ord > 0') + ' > 0')} AS has_ever_ordered, {s('to_ord', 0, hi)} AS lifetime_orders, {s('gmv', 0, hi)} AS lifetime_gmv,
 {n(0, hi, 'to_ord > 0')} AS lifetime_purchase_days"""


query("lifetime", sql=ctes(LOG, QUARTER_CTE, HIST) + f"SELECT anchor_date, user_id, {lifetime_sql(100000)} {PER_USER}")(lambda t: W.lifetime(t.log, t.quarters))
EWMA_SQL = ", ".join(f"coalesce(sum({m} * exp(-age / {tau}.0)) FILTER (WHERE {span(0, 364)}), 0) AS ewma_{name}_tau{tau}"
                     for m, name in {"searches": "searches", "to_cart": "carts", "gmv": "gmv", "cat": "cat"}.items() for tau in (7, 30))
query("ewma_decay", sql=ctes(LOG, QUARTER_CTE, HIST) + f"SELECT anchor_date, user_id, {EWMA_SQL} {PER_USER}")(lambda t: W.ewma_decay(t.log, t.quarters))
G90 = f"gmv FILTER (WHERE {span(0, 89)})"


def moment_sql(k: int) -> str:
    """Biased skewness and excess kurtosis of the 90-day amounts, 0 where undefined."""
    x = f"list(gmv) FILTER (WHERE {span(0, 89)})"
    m = lambda p: f"list_avg(list_transform({x}, lambda v: pow(v - list_avg({x}), {p})))"
    shape = f"{m(3)} / pow({m(2)}, 1.5)" if k == 3 else f"{m(4)} / pow({m(2)}, 2) - 3"
    return f"CASE WHEN coalesce(stddev_pop(gmv) FILTER (WHERE {span(0, 89)}), 0) > 0 THEN {shape} ELSE 0 END"


DYNAMICS_SQL = f"""{n(0, 89, 'gmv > 2.5 * mean90')} AS ts_gmv_spike_count_90d, {n(0, 89, 'gmv > 0')} / ({n(0, 89, 'searches > 0')} + 1e-5) AS ts_active_conversion_efficiency,
 {s('gmv', 0, 13)} / ({s('gmv', 14, 44)} / 2 + 1e-5) AS ts_gmv_acceleration_ratio, {s('searches', 0, 13)} / ({s('searches', 14, 44)} / 2 + 1e-5) AS ts_search_acceleration_ratio,
 {s('gmv', 0, 89, 'isodow(event_date) >= 6')} / ({s('gmv', 0, 89, 'isodow(event_date) <= 5')} / 2.5 + 1e-5) AS ts_weekend_bias_ratio,
 coalesce(max(gmv) FILTER (WHERE {span(0, 89)}), 0) / ({s('gmv', 0, 89)} / 90 + 1e-5) AS ts_peak_to_mean_gmv_90d,
 coalesce(stddev_samp(gmv) FILTER (WHERE {span(0, 89)}), 0) / ({s('gmv', 0, 89)} / 90 + 1e-5) AS ts_gmv_volatility_coef_90d,
 {moment_sql(3)} AS ts_gmv_skewness_90d, {moment_sql(4)} AS ts_gmv_kurtosis_90d"""
SPIKE = f"h2 AS (SELECT *, coalesce(sum(gmv) FILTER (WHERE {span(0, 89)}) OVER (PARTITION BY anchor_date, user_id), 0) / 90 AS mean90 FROM h)"
query("ts_dynamics", sql=ctes(LOG, QUARTER_CTE, HIST, SPIKE) + f"SELECT anchor_date, user_id, {DYNAMICS_SQL} FROM h2 GROUP BY anchor_date, user_id")(
    lambda t: W.ts_dynamics(t.log, t.quarters))
SHORT_SQL = ", ".join(f"{s(m, 0, d - 1)} AS {name}_{d}d" for d in W.SHORT_DAYS for m, name in W.SHORT_METRICS.items())
query("short_window_sums", sql=ctes(LOG, QUARTER_CTE, HIST) + f"SELECT anchor_date, user_id, {SHORT_SQL}, {recency_sql(364, 'NULL')} {PER_USER}")(
    lambda t: W.short_window_sums(t.log, t.quarters))
query("daily_rollup", DAY, """SELECT user_id, CAST(ts AS DATE) AS event_date, sum(value) AS amount, count(*) AS n,
 max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS had_error FROM events GROUP BY 1, 2""")(
    lambda t: W.daily_rollup(t.read("events").select("user_id", F.col("ts").cast("date").alias("event_date"), F.col("value").alias("amount"), F.lit(1).alias("n"),
                                                     F.when(F.col("event_type") == "error", 1).otherwise(0).alias("had_error")), ["amount", "n"], ["had_error"]))
PLATFORM_SQL = f"""p AS (SELECT event_date, count(DISTINCT user_id) AS global_dau, count(DISTINCT user_id) FILTER (WHERE {BUY}) AS global_buyers,
 sum(gmv) AS global_gmv, sum(to_ord) AS global_orders, count(DISTINCT user_id) FILTER (WHERE {BUY}) / (count(DISTINCT user_id) + 1e-5) AS global_buyer_rate,
 sum(gmv) / (count(DISTINCT user_id) + 1e-5) AS global_gmv_per_active, sum(to_ord) / (count(DISTINCT user_id) FILTER (WHERE {BUY}) + 1e-5) AS global_orders_per_buyer,
 sum(gmv) / (sum(to_ord) + 1e-5) AS global_gmv_per_order FROM log GROUP BY event_date)"""
query("platform_daily", ("event_date",), ctes(LOG, PLATFORM_SQL) + "SELECT * FROM p")(lambda t: W.platform_daily(t.log))
query("platform_daily_events", ("event_date",), ctes(CLICKS, PLATFORM_SQL) + "SELECT * FROM p")(lambda t: W.platform_daily(t.clicks))
AT_ANCHOR_SQL = """pa AS (SELECT anchor_date, avg(global_dau) FILTER (WHERE r <= 7) AS global_dau_7d_mean, avg(global_dau) AS global_dau_30d_mean,
 avg(global_gmv_per_active) FILTER (WHERE r <= 7) AS global_gmv_per_active_7d, avg(global_gmv_per_active) AS global_gmv_per_active_30d,
 avg(global_buyer_rate) AS global_buyer_rate_30d FROM (SELECT *, row_number() OVER (PARTITION BY anchor_date ORDER BY event_date DESC) AS r
 FROM a JOIN p ON event_date <= anchor_date) WHERE r <= 30 GROUP BY anchor_date)"""
query("platform_at_anchor", ANCHOR, ctes(LOG, QUARTER_CTE, PLATFORM_SQL, AT_ANCHOR_SQL) + "SELECT * FROM pa")(
    lambda t: W.platform_at_anchor(W.platform_daily(t.log), t.quarters))
query("daily_totals", ("event_date",), ctes(LOG) + "SELECT event_date, count(*) AS active_users, sum(gmv) AS gmv_total, sum(to_ord) AS to_ord_total, sum(searches) AS searches_total FROM log GROUP BY 1")(
    lambda t: W.daily_totals(t.log, ["gmv", "to_ord", "searches"]))
query("user_totals", ("user_id", "first_day", "last_day"), ctes(LOG) + "SELECT user_id, sum(gmv) AS lifetime_gmv, count(*) AS active_days, max(gmv) AS max_day_gmv, min(event_date) AS first_day, max(event_date) AS last_day FROM log GROUP BY 1")(
    lambda t: W.user_totals(t.log))
query("cumulative_amount", DAY, ctes(LOG) + "SELECT user_id, event_date, gmv, sum(gmv) OVER (PARTITION BY user_id ORDER BY event_date) AS cumulative_gmv FROM log")(
    lambda t: W.cumulative_amount(t.log))

# --- projections and fold features ----------------------------------------------------------

FUNNEL = {}
for _d in (90, 30):
    FUNNEL.update({f"mean_gmv_per_order_{_d}d": (f"gmv_sum_{_d}d", f"to_ord_sum_{_d}d"), f"mean_gmv_per_active_day_{_d}d": (f"gmv_sum_{_d}d", f"active_days_{_d}d"),
                   f"cart_conversion_rate_{_d}d": (f"to_cart_sum_{_d}d", f"searches_sum_{_d}d"), f"order_conversion_rate_{_d}d": (f"to_ord_sum_{_d}d", f"to_cart_sum_{_d}d"),
                   f"search_to_order_rate_{_d}d": (f"to_ord_sum_{_d}d", f"searches_sum_{_d}d")})
FUNNEL.update({f"{k}_trend_30_60d": (f"{m}_sum_30d", f"{m}_sum_30_60d") for k, m in {"cart": "to_cart", "search": "searches", "gmv": "gmv"}.items()})
FUNNEL_SQL = ", ".join(f"{a} / ({b} + 1e-5) AS {k}" for k, (a, b) in FUNNEL.items())
FILLED = "SELECT anchor_date, user_id, coalesce(COLUMNS(* EXCLUDE (anchor_date, user_id)), 0) AS \"\\0\""
query("money_funnel_ratios", sql=ctes(LOG, CV, HIST) + f", f AS (SELECT anchor_date, user_id, {FOLD_AGG_SQL}, {FOLD_RECENCY_SQL} {PER_USER}) SELECT anchor_date, user_id, {FUNNEL_SQL} FROM f")(
    lambda t: W.fold_features(t.log, t.cv).select("anchor_date", "user_id", *FUNNEL))
query("fold_features", sql=ctes(LOG, CV, HIST, HOLIDAY_SQL) + f""", f0 AS (SELECT anchor_date, user_id, {FOLD_AGG_SQL}, {FOLD_RECENCY_SQL} {PER_USER}),
 f AS ({FILLED} FROM f0), hd AS (SELECT anchor_date, {', '.join(f"{next_sql('anchor_date', m, d)} - anchor_date AS days_to_{k}" for k, (m, d) in A.DISTANCE_HOLIDAYS.items())},
 (SELECT {flag_sql('count(*) > 0')} FROM hol WHERE holiday BETWEEN anchor_date + 1 AND anchor_date + 30) AS target_window_covers_holiday FROM a)
 SELECT f.*, hd.* EXCLUDE (anchor_date), {FUNNEL_SQL} FROM f JOIN hd USING (anchor_date)""")(lambda t: W.fold_features(t.log, t.cv))
