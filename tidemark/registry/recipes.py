"""Queries for whole recipes with a least-squares learner, which SQL repeats, and for the final runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.lineage import cut_lineage
from tidemark.operators import anchors as A
from tidemark.operators import btyd as B
from tidemark.operators import scoring as X
from tidemark.plans import final as N
from tidemark.plans import meta as P
from tidemark.plans import models as G
from tidemark.plans import runs as R
from tidemark.registry.base import QUARTERS, clip_sql, query
from tidemark.registry.features import scratch, template
from tidemark.registry.forecasts import AMOUNT, AU, CHURN, FIXED, INPUTS, REACT, SCZ, SIG, VALID, fold_inputs, split, z_frame
from tidemark.sources.activity import checked_log

ORDERS, SINCE = "to_ord_sum_90d", "days_since_last_order"
LINE = {"learner": "line"}
Z, Z30, BUYS = "ln(1 + target)", "ln(1 + gmv_sum_30d)", "CASE WHEN target > 0 THEN 1 ELSE 0 END"


def line_sql(name: str, x: str, y: str, cond: str = "true", rows: str = "tr", weight: str = "1.0") -> str:
    """A table with the slope ``k`` and the intercept ``c`` of weighted least squares of ``y`` on ``x``."""
    return f"""{name} AS (SELECT k, my - k * mx AS c FROM (SELECT any_value(mx) AS mx, any_value(my) AS my, sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS k FROM
 (SELECT *, sum(w * x) OVER () / sum(w) OVER () AS mx, sum(w * y) OVER () / sum(w) OVER () AS my FROM (SELECT {x}::DOUBLE AS x, ({y})::DOUBLE AS y, ({weight})::DOUBLE AS w FROM {rows} WHERE {cond}))))"""


def at(name: str, x: str) -> str:
    return f"({name}.c + {name}.k * {x})"


def share(name: str, x: str) -> str:
    return clip_sql(at(name, x), 0, 1)


TRAIN = f"anchor_date < DATE '{VALID}'"
PARTS = f"tr AS (SELECT * FROM zf WHERE {TRAIN}), va AS (SELECT * FROM zf WHERE anchor_date = DATE '{VALID}')"
MONEY = lambda x: f"greatest(exp({x}) - 1, 0)"


def fitted(*lines: str) -> str:
    return SCZ + ", " + ", ".join((PARTS, *lines)) + " "


def recipe(name: str, sql: str, build) -> None:
    """Register ``build(train, valid)`` over the panel's train and validation rows."""
    query(name, AU, sql)(lambda t: build(*split(t)))


def bare(valid):
    return valid.select(*AU, "target", *INPUTS)


recipe("direct_regressor_linear", fitted(line_sql("d", ORDERS, Z)) + f"SELECT anchor_date, user_id, target, {at('d', ORDERS)} AS prediction_z FROM va, d",
       lambda train, valid: G.direct_regressor(train, [ORDERS], **LINE).add(bare(valid), "prediction_z").select(*AU, "target", "prediction_z"))
HURDLE = [("p0", BUYS, "true"), ("a0", Z, "target > 0"), ("d", Z, "true")]
P0, A0, D0 = share("p0", ORDERS), at("a0", ORDERS), at("d", ORDERS)
FINAL = MONEY(f"{D0} * 0.5 + pow({P0}, 1.1) * {A0} * 0.5")
recipe("hurdle_linear", fitted(*(line_sql(n, ORDERS, y, c) for n, y, c in HURDLE)) + f"""SELECT anchor_date, user_id, target, {MONEY(f'{P0} * {A0}')} AS pred_a, {P0} * {MONEY(A0)} AS pred_b, {MONEY(D0)} AS pred_c,
 ({MONEY(f'{P0} * {A0}')} + {MONEY(D0)}) / 2 AS pred_d, {FINAL} AS pred_final FROM va, p0, a0, d""",
       lambda train, valid: G.hurdle_combinations(G.fit_hurdle(train, [ORDERS], **LINE).add(bare(valid))).select(*AU, "target", "pred_a", "pred_b", "pred_c", "pred_d", "pred_final"))
RE, CH, AM = share("re", SINCE), share("ch", SINCE), at("am", SINCE)
P_BUY = clip_sql(f"CASE WHEN was_active = 1 THEN 1 - {CH} ELSE {RE} END", 1e-6, "1 - 1e-6")
# inactive users have no order in the window, so all of them have the same days since the last one: the mean
recipe("transition_specialists_linear", fitted("re AS (SELECT avg(will_buy) AS c, 0 AS k FROM tr WHERE was_active = 0)", line_sql("ch", SINCE, "1 - will_buy", "was_active = 1"), line_sql("am", SINCE, "z_target", "will_buy = 1"))
       + f"SELECT anchor_date, user_id, {RE} AS p_react, {CH} AS p_churn, {P_BUY} AS p_buy, greatest(pow({P_BUY}, 1.1) * greatest({AM}, 0), 0) AS prediction_z FROM va, re, ch, am",
       lambda train, valid: G.transition_specialists(train, [SINCE], **LINE).add(valid.select(*AU, "was_active", SINCE)).select(*AU, "p_react", "p_churn", "p_buy", "prediction_z"))
ACTIVE = "gmv_sum_90d > 0"
recipe("cohort_specialist_linear", fitted(line_sql("b1", SINCE, BUYS, ACTIVE, weight="CASE WHEN gmv_sum_30d = 0 THEN 1.5 ELSE 1 END"), line_sql("a1", SINCE, Z, f"{ACTIVE} AND target > 0"),
                                          f"d1 AS (SELECT avg({Z}) AS c, 0 AS k FROM tr WHERE NOT {ACTIVE})")
       + f"SELECT anchor_date, user_id, target, {clip_sql(f'CASE WHEN {ACTIVE} THEN {share('b1', SINCE)} * {at('a1', SINCE)} ELSE {at('d1', SINCE)} END', 0, 15)} AS prediction_z FROM va, b1, a1, d1",
       lambda train, valid: G.cohort_specialist(train, bare(valid), [SINCE], borderline_weight=1.5, **LINE).select(*AU, "target", "prediction_z"))
OFTEN = f"{ORDERS} >= 2"
recipe("frequency_specialist_linear", fitted(line_sql("hi", SINCE, Z, OFTEN), line_sql("lo", SINCE, Z, f"NOT {OFTEN}"))
       + f"SELECT anchor_date, user_id, target, {clip_sql(f'CASE WHEN {OFTEN} THEN {at('hi', SINCE)} ELSE {at('lo', SINCE)} END', 0, 15)} AS prediction_z FROM va, hi, lo",
       lambda train, valid: G.frequency_specialist(train, bare(valid), [SINCE], **LINE).select(*AU, "target", "prediction_z"))
recipe("delta_regressor_linear", fitted(line_sql("dl", ORDERS, f"{Z} - {Z30}")) + f"SELECT anchor_date, user_id, target, {clip_sql(f'{at('dl', ORDERS)} + {Z30}', 0, 15)} AS prediction_z FROM va, dl",
       lambda train, valid: G.delta_regressor(train, bare(valid), [ORDERS], **LINE).select(*AU, "target", "prediction_z"))
FOLDS = {f"q{i}": a for i, a in enumerate(QUARTERS[-4:])}
query("buy_classifier_oof_linear", AU, SCZ + ", " + ", ".join(line_sql(q, ORDERS, BUYS, f"anchor_date + 30 <= DATE '{a}'", "zf") for q, a in FOLDS.items()) + " " + " UNION ALL ".join(
    f"SELECT anchor_date, user_id, target, {share(q, ORDERS)} AS p FROM zf, {q} WHERE anchor_date = DATE '{a}'" for q, a in FOLDS.items()))(
    lambda t: G.classifier_oof(cut_lineage(z_frame(t)), list(FOLDS.values()), [ORDERS], **LINE))


# --- final runs -----------------------------------------------------------------------------

LAST_DAY = "fin AS (SELECT max(event_date) AS anchor_date FROM log)"
LATE, NEWEST = QUARTERS[4], QUARTERS[8]
WEIGHT_SQL = f"CASE WHEN anchor_date >= DATE '{NEWEST}' THEN 2.5 WHEN anchor_date >= DATE '{LATE}' THEN 1.5 ELSE 1 END"


def last_day(t):
    """The anchor whose target is unknown: the last day of the log."""
    return t.log.agg(F.max("event_date").alias("anchor_date"))


@query("submission_job", ("user_id",), SCZ + ", " + ", ".join((
    *(line_sql(n, ORDERS, y, c, "zf", WEIGHT_SQL) for n, y, c in HURDLE), LAST_DAY,
    f"fr AS (SELECT u.user_id, coalesce(sum(to_ord) FILTER (WHERE fin.anchor_date - event_date BETWEEN 0 AND 89), 0) AS {ORDERS} FROM u CROSS JOIN fin LEFT JOIN log ON log.user_id = u.user_id GROUP BY 1)"))
    + f" SELECT user_id, {FINAL} AS predict FROM fr, p0, a0, d")
def _(t):
    panel = cut_lineage(A.anchor_weights(z_frame(t), LATE, NEWEST).select(*AU, "target", "weight", ORDERS))
    return N.submission_job(panel, fold_inputs(t.log, last_day(t)), template(t), [ORDERS], scratch(t, "submission"), weight="weight", **LINE)


def frozen(t):
    """The panel of outputs, and the weights fitted on its rows before the last anchor."""
    panel = cut_lineage(z_frame(t).drop("prediction"))
    meta, _ = P.fit_meta(panel.where(TRAIN), ["a_react_logit"], ["a_churn_logit"], ["a_amount_z"])
    # the weights are for the fitted models' columns of the same kind
    return panel, X.Meta({"react_logit": 1.0}, {"churn_logit": 1.0}, {"amount_z": meta.amount["a_amount_z"]}, {"amount_z": meta.mean["a_amount_z"]}, {"amount_z": meta.scale["a_amount_z"]},
                         meta.intercept, meta.alpha)


@query("final_run", ("user_id",))
def _(t):
    panel, meta = frozen(t)
    rows = fold_inputs(t.log, last_day(t)).withColumn("was_active", (F.col("gmv_sum_90d") > 0).cast("int"))
    day = str(last_day(t).first()["anchor_date"])
    return N.final_run(panel, rows, template(t), day, INPUTS, meta, scratch(t, "final"))


@query("regularised_meta", ("fold", "anchor_date", "class_penalty", "amount_penalty"))
def _(t):
    meta, path, choice = P.regularised_meta(z_frame(t).drop("prediction"), QUARTERS[-4:], REACT, CHURN, AMOUNT, ["direct_z"], class_penalties=(0.0, 1e-3, 1e-1), amount_penalties=(0.0, 1e-2, 1.0))
    return path.withColumns({"chosen": ((F.col("class_penalty") == choice["class_penalty"]) & (F.col("amount_penalty") == choice["amount_penalty"])).cast("int"),
                             "pooled_cost": F.lit(choice["pooled_cost"]), "intercept": F.lit(meta.intercept)})


OTHER = X.Meta({"a_react_logit": 0.2, "b_react_logit": 0.8}, {"a_churn_logit": 0.5, "b_churn_logit": 0.5}, {"a_amount_z": 0.7, "b_amount_z": 0.1},
               {"a_amount_z": 5.0, "b_amount_z": 4.0}, {"a_amount_z": 2.0, "b_amount_z": 3.0}, 7.0, 1.1, {"hurdle": 0.6, "direct_z": 0.4})


def bank_sql(name: str, meta: X.Meta) -> str:
    add = lambda d: " + ".join(f"{w} * {c}" for c, w in d.items())
    amount = " + ".join(f"({c} - {meta.mean[c]}) / {meta.scale[c]} * {w}" for c, w in meta.amount.items())
    return f"""{name} AS (SELECT anchor_date, user_id, was_active, will_buy, z_target, p_react, p_churn, cz, greatest({meta.blend['hurdle']} * pow(CASE WHEN was_active = 0 THEN p_react ELSE 1 - p_churn END, 1.1) * cz
 + {meta.blend['direct_z']} * direct_z, 0) AS pz FROM (SELECT *, {SIG(add(meta.react))} AS p_react, {SIG(add(meta.churn))} AS p_churn, greatest({meta.intercept} + {amount}, 0) AS cz FROM zf))"""


def part_sql(section: str, part: str, cond: str, error) -> str:
    return f"SELECT '{section}' AS section, '{part}' AS part, count(*) AS n, avg({error('x')}) AS before, avg({error('y')}) AS after, avg({error('y')}) - avg({error('x')}) AS delta FROM x JOIN y USING (anchor_date, user_id) WHERE {cond}"


def log_loss_sql(p: str, y: str):
    return lambda side: f"CASE WHEN {y} THEN -ln({clip_sql(f'{side}.{p}', 1e-6, '1 - 1e-6')}) ELSE -ln(1 - {clip_sql(f'{side}.{p}', 1e-6, '1 - 1e-6')}) END"


SQUARE = lambda c: lambda side: f"pow({side}.{c} - x.z_target, 2)"
query("gate_report", ("section", "part"), SCZ + ", " + bank_sql("x", FIXED) + ", " + bank_sql("y", OTHER) + " " + " UNION ALL ".join((
    part_sql("all", "all", "true", SQUARE("pz")), *(part_sql("state", f"{a}{b}", f"x.was_active = {a} AND x.will_buy = {b}", SQUARE("pz")) for a in (0, 1) for b in (0, 1)),
    part_sql("part", "react", "x.was_active = 0", log_loss_sql("p_react", "x.will_buy = 1")), part_sql("part", "churn", "x.was_active = 1", log_loss_sql("p_churn", "x.will_buy = 0")),
    part_sql("part", "amount", "x.will_buy = 1", SQUARE("cz")))))(
    lambda t: (lambda z: R.gate_report(X.apply_meta(z, FIXED), X.apply_meta(z, OTHER)))(cut_lineage(z_frame(t).drop("prediction"))))


# --- purchase model over all train anchors --------------------------------------------------

@query("pooled_btyd", AU)
def _(t):
    return B.pooled_btyd(t.log, A.anchor_table(t.spark, QUARTERS[:-1]), A.anchor_table(t.spark, QUARTERS[-2:]))


# --- raw rows with faults made from the orders ----------------------------------------------

BROKEN = {"user_id": "CASE WHEN o_orderkey % 97 = 0 THEN 'u' || o_custkey ELSE CAST(o_custkey AS STRING) END",
          "event_date": "CASE WHEN o_orderkey % 89 = 0 THEN '2001-02-30' WHEN o_orderkey % 83 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END",
          "gmv": "CASE WHEN o_orderkey % 79 = 0 THEN 'n/a' WHEN o_orderkey % 73 = 0 THEN 'NaN' WHEN o_orderkey % 71 = 0 THEN '-5' ELSE CAST(CAST(FLOOR(o_totalprice) AS BIGINT) AS STRING) END",
          "to_ord": "CASE WHEN o_orderkey % 67 = 0 THEN NULL ELSE '1' END"}
ZEROS = ["searches", "cat", "to_cart", "search_to_cart", "cat_to_cart", "search_to_ord", "cat_to_ord", "gmv_search", "gmv_cat"]
DUCK = {c: x.replace("STRING", "VARCHAR") for c, x in BROKEN.items()}
query("read_activity_log_rejects", ("reject_reason",), f"""WITH raw AS (SELECT {', '.join(f'{x} AS {c}' for c, x in DUCK.items())} FROM orders),
 ty AS (SELECT try_cast(user_id AS BIGINT) AS user_id, try_cast(event_date AS DATE) AS event_date, try_cast(gmv AS DOUBLE) AS gmv, gmv AS gmv_text, coalesce(try_cast(to_ord AS BIGINT), 0) AS to_ord FROM raw),
 r AS (SELECT *, CASE WHEN user_id IS NULL THEN 'no user' WHEN event_date IS NULL THEN 'no date' WHEN gmv_text IS NOT NULL AND (gmv IS NULL OR NOT isfinite(gmv)) THEN 'not a number' WHEN gmv < 0 THEN 'negative' END AS reason FROM ty),
 n AS (SELECT user_id, event_date, count(*) AS n FROM r WHERE reason IS NULL GROUP BY 1, 2)
 SELECT CASE WHEN reason IS NULL AND n > 1 THEN 'duplicate user and day' ELSE coalesce(reason, 'none') END AS reject_reason, count(*) AS n_rows, count(DISTINCT r.user_id) AS n_users,
 sum(CASE WHEN reason IS NULL THEN to_ord END) AS orders, sum(CASE WHEN reason IS NULL THEN gmv END) AS gmv
 FROM r LEFT JOIN n ON r.reason IS NULL AND n.user_id = r.user_id AND n.event_date = r.event_date GROUP BY 1""")(
    lambda t: checked_log(t.read("orders").selectExpr(*[f"{x} AS {c}" for c, x in BROKEN.items()], *[f"'0' AS {c}" for c in ZEROS])).groupBy(
        F.coalesce("reject_reason", F.lit("none")).alias("reject_reason")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_users"),
        F.sum(F.when(F.coalesce("reject_reason", F.lit("none")).isin("none", "duplicate user and day"), F.col("to_ord"))).alias("orders"),
        F.sum(F.when(F.coalesce("reject_reason", F.lit("none")).isin("none", "duplicate user and day"), F.col("gmv"))).alias("gmv")))
