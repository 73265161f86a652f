"""Queries for scoring formulas, blends, models and validation runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exprs import log_amount, logit
from tidemark.functions.lineage import cut_lineage
from tidemark.operators import index as I
from tidemark.operators import metrics as M
from tidemark.operators import scoring as X
from tidemark.operators import windows as W
from tidemark.operators.anchors import anchor_table
from tidemark.plans import models as G
from tidemark.plans import runs as R
from tidemark.registry.base import QUARTERS, clip_sql, ctes, query
from tidemark.registry.reports import FEATURES, SC, scored

INPUTS = FEATURES
VALID = QUARTERS[-1]
AU = ("anchor_date", "user_id")
MODEL_KEYS = ("anchor_date", "user_id")


def z_frame(t):
    """Scored frame with logits and log predictions of two stand-in models."""
    return scored(t).withColumns({
        "a_react_logit": logit("p", 1e-6), "b_react_logit": logit("p2", 1e-6), "a_churn_logit": -logit("p", 1e-6), "b_churn_logit": -logit("p2", 1e-6),
        "a_amount_z": log_amount("prediction"), "b_amount_z": log_amount("prediction2"), "direct_z": log_amount("naive_mean_3"),
    })


LOGIT = lambda p: f"ln({clip_sql(p, 1e-6, '1 - 1e-6')} / (1 - {clip_sql(p, 1e-6, '1 - 1e-6')}))"
SIG = lambda x: f"(1 / (1 + exp(-({x}))))"
ZF = f"""zf AS (SELECT *, {LOGIT('p')} AS a_react_logit, {LOGIT('p2')} AS b_react_logit, -{LOGIT('p')} AS a_churn_logit, -{LOGIT('p2')} AS b_churn_logit,
 ln(1 + prediction) AS a_amount_z, ln(1 + prediction2) AS b_amount_z, ln(1 + naive_mean_3) AS direct_z FROM sc)"""
SCZ = SC + ", " + ZF + " "
PBUY = clip_sql("CASE WHEN was_active = 1 THEN 1 - (1 - p) ELSE p2 END", 1e-6, "1 - 1e-6")

# --- scoring --------------------------------------------------------------------------------

query("assemble_probability", AU, SCZ + f"SELECT anchor_date, user_id, {PBUY} AS p_buy FROM zf")(
    lambda t: scored(t).select("anchor_date", "user_id", X.assemble_probability(F.col("was_active"), F.col("p2"), 1 - F.col("p")).alias("p_buy")))
query("factorised_prediction", AU, SCZ + f"SELECT anchor_date, user_id, {PBUY} AS p_buy, pow({PBUY}, 1.1) * a_amount_z AS factorized_z, exp(pow({PBUY}, 1.1) * a_amount_z) - 1 AS prediction FROM zf")(
    lambda t: X.factorised_prediction(z_frame(t).drop("prediction").withColumn("_c", 1 - F.col("p")), "p2", "_c", "a_amount_z").select(
        "anchor_date", "user_id", "p_buy", "factorized_z", "prediction"))
query("soft_threshold", AU, SCZ + f"SELECT anchor_date, user_id, {clip_sql('(p - 0.3) / (1 - 0.3)', 0, 1)} AS p_soft FROM zf")(
    lambda t: scored(t).select("anchor_date", "user_id", X.soft_threshold(F.col("p"), 0.3).alias("p_soft")))
FIXED = X.Meta({"a_react_logit": 0.6, "b_react_logit": 0.4}, {"a_churn_logit": 0.3, "b_churn_logit": 0.7}, {"a_amount_z": 0.5, "b_amount_z": 0.4},
               {"a_amount_z": 5.0, "b_amount_z": 4.0}, {"a_amount_z": 2.0, "b_amount_z": 3.0}, 8.0, 1.1, {"hurdle": 0.8, "direct_z": 0.2})
META_SQL = f"""m AS (SELECT *, CASE WHEN was_active = 0 THEN p_react ELSE 1 - p_churn END AS p_buy, greatest(8 + (a_amount_z - 5) / 2.0 * 0.5 + (b_amount_z - 4) / 3.0 * 0.4, 0) AS conditional_z FROM
 (SELECT *, {SIG('0.6 * a_react_logit + 0.4 * b_react_logit')} AS p_react, {SIG('0.3 * a_churn_logit + 0.7 * b_churn_logit')} AS p_churn FROM zf))"""
query("apply_meta", AU, SCZ + f", {META_SQL} SELECT anchor_date, user_id, p_buy, conditional_z, pow(p_buy, 1.1) * conditional_z AS hurdle_z, 0.8 * pow(p_buy, 1.1) * conditional_z + 0.2 * direct_z AS prediction_z FROM m")(
    lambda t: X.apply_meta(z_frame(t).drop("prediction"), FIXED).select("anchor_date", "user_id", "p_buy", "conditional_z", "hurdle_z", "prediction_z"))
query("log_space_blend", AU, SCZ + f"SELECT anchor_date, user_id, {clip_sql('0.5 * a_amount_z + 0.3 * b_amount_z + 0.2 * ln(1 + naive_mean_2)', 0, 15)} AS blend_z FROM zf")(
    lambda t: X.log_space_blend(z_frame(t), {"a_amount_z": .5, "b_amount_z": .3, "naive_mean_2": .2}, ["naive_mean_2"], "blend").select("anchor_date", "user_id", "blend_z"))
query("sweep_alpha", ("anchor_date",), SCZ + """SELECT anchor_date, grid, count(*) AS n, avg(pow(pow(p, grid) * a_amount_z - z_target, 2)) AS mse, sqrt(avg(pow(pow(p, grid) * a_amount_z - z_target, 2))) AS rmsle
 FROM zf, (VALUES (0.9::DOUBLE), (1.0), (1.1), (1.3), (1.5)) AS g(grid) GROUP BY 1, 2""")(
    lambda t: X.sweep_parameter(z_frame(t), [.9, 1., 1.1, 1.3, 1.5], lambda g: F.pow("p", g) * F.col("a_amount_z"), keys=["anchor_date"]))
query("sweep_blend_weight", (), SCZ + """SELECT grid, count(*) AS n, avg(pow((1 - grid) * a_amount_z + grid * b_amount_z - z_target, 2)) AS mse, sqrt(avg(pow((1 - grid) * a_amount_z + grid * b_amount_z - z_target, 2))) AS rmsle
 FROM zf, (SELECT i / 10 AS grid FROM range(11) AS r(i)) GROUP BY 1""")(
    lambda t: X.sweep_parameter(z_frame(t), [i / 10 for i in range(11)], lambda g: (F.lit(1.0) - g) * F.col("a_amount_z") + g * F.col("b_amount_z")))
BLENDS = {"only_a": {"a_amount_z": 1.0}, "half": {"a_amount_z": 0.5, "b_amount_z": 0.5}, "three": {"a_amount_z": 0.5, "b_amount_z": 0.3, "direct_z": 0.2}}
BLEND_SQL = {k: " + ".join(f"{w} * {c}" for c, w in b.items()) for k, b in BLENDS.items()}
query("compare_blends", ("blend",), SCZ + " UNION ALL ".join(
    f"SELECT '{k}' AS blend, avg(pow({x} - z_target, 2)) AS mse, sqrt(avg(pow({x} - z_target, 2))) AS rmsle, "
    + ", ".join(f"avg(pow({x} - z_target, 2)) FILTER (WHERE transition_state = '{s}') AS mse_{s}" for s in ("00", "01", "10", "11")) + " FROM zf" for k, x in BLEND_SQL.items()))(
    lambda t: X.compare_blends(z_frame(t), BLENDS))
query("make_prediction_bank", AU, SCZ + "SELECT anchor_date, user_id, was_active, will_buy, z_target, a_react_logit, a_churn_logit, direct_z FROM zf")(
    lambda t: (lambda z: X.make_prediction_bank(z.select(*AU, "was_active", "will_buy", "z_target"), [z.select(*AU, "a_react_logit", "a_churn_logit"), z.select(*AU, "direct_z")]))(
        cut_lineage(z_frame(t))))
BIN = lambda name, cond, y, x: f"SELECT '{name}' AS part, count(*) AS n, NULL AS mse, -avg({y} * ln({clip_sql(SIG(x), 1e-6, '1 - 1e-6')}) + (1 - {y}) * ln(1 - {clip_sql(SIG(x), 1e-6, '1 - 1e-6')})) AS log_loss, avg(pow({SIG(x)} - {y}, 2)) AS brier FROM zf WHERE {cond}"
query("individual_metrics", ("part",), SCZ + "SELECT 'direct' AS part, count(*) AS n, avg(pow(direct_z - z_target, 2)) AS mse, NULL AS log_loss, NULL AS brier FROM zf UNION ALL "
      + BIN("react", "was_active = 0", "will_buy", "a_react_logit") + " UNION ALL " + BIN("churn", "was_active = 1", "(1 - will_buy)", "a_churn_logit")
      + f" UNION ALL SELECT 'amount', count(*), avg(pow(a_amount_z - z_target, 2)), NULL, NULL FROM zf WHERE will_buy = 1 UNION ALL SELECT 'standalone_hurdle', count(*), avg(pow(pow(CASE WHEN was_active = 0 THEN {SIG('a_react_logit')} ELSE 1 - {SIG('a_churn_logit')} END, 1.1) * a_amount_z - z_target, 2)), NULL, NULL FROM zf")(
    lambda t: X.individual_metrics(z_frame(t), "a_react_logit", "a_churn_logit", "a_amount_z", "direct_z"))


@query("fit_blend", ("column",))
def _(t):
    z = z_frame(t)
    weights = X.fit_blend(z.where(f"anchor_date < '{VALID}'"), ["a_amount_z", "b_amount_z", "direct_z"])
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(w).alias("weight")) for c, w in weights.items()]))
    return M.rmsle(X.log_space_blend(z.drop("prediction"), weights), []).select("rmsle", rows)


def meta_rows(meta: X.Meta):
    flat = {f"{kind}.{c}": w for kind in ("react", "churn", "amount", "blend") for c, w in getattr(meta, kind).items()} | {"intercept": meta.intercept}
    return F.inline(F.array(*[F.struct(F.lit(k).alias("weight_name"), F.lit(float(w)).alias("weight")) for k, w in flat.items()]))


REACT, CHURN, AMOUNT = ["a_react_logit", "b_react_logit"], ["a_churn_logit", "b_churn_logit"], ["a_amount_z", "b_amount_z"]


@query("fit_meta_weights", ("weight_name",))
def _(t):
    z = z_frame(t).drop("prediction")
    meta = X.fit_meta_weights(z.where(f"anchor_date < '{VALID}'"), REACT, CHURN, AMOUNT, ["direct_z"])
    return M.rmsle(X.apply_meta(z, meta), []).select("rmsle", meta_rows(meta))


@query("one_standard_error", (), SCZ + """, f AS (SELECT grid, anchor_date, avg(pow(pow(p, grid) * a_amount_z - z_target, 2)) AS score FROM zf, (VALUES (0.9::DOUBLE), (1.0), (1.1), (1.3), (1.5)) AS g(grid) GROUP BY 1, 2),
 s AS (SELECT grid, avg(score) AS mean_score, stddev_samp(score) / sqrt(count(*)) AS se FROM f GROUP BY 1), lim AS (SELECT mean_score + se AS l FROM s ORDER BY mean_score LIMIT 1)
 SELECT grid AS penalty, mean_score FROM s, lim WHERE mean_score <= l ORDER BY grid DESC LIMIT 1""")
def _(t):
    swept = X.sweep_parameter(z_frame(t), [.9, 1., 1.1, 1.3, 1.5], lambda g: F.pow("p", g) * F.col("a_amount_z"), keys=["anchor_date"])
    return X.one_standard_error(swept.select(F.col("grid").alias("penalty"), F.col("mse").alias("score")))


# --- models (fitted, so no SQL) -------------------------------------------------------------

def split(t, columns=None):
    """Train rows (anchors legal for the last one) and validation rows of the panel, or some of its columns.

    Fitted trees differed when the checkpoint was narrower (probably by its other partitions), so recipes with trees take all columns.
    """
    rows = cut_lineage(z_frame(t) if columns is None else z_frame(t).select(*columns))
    return rows.where(f"anchor_date < '{VALID}'"), rows.where(f"anchor_date = '{VALID}'")


@query("direct_regressor", MODEL_KEYS)
def _(t):
    train, valid = split(t)
    return G.direct_regressor(train, INPUTS).add(valid.select(*AU, "target", *INPUTS), "prediction_z").select(*AU, "target", "prediction_z")


@query("buy_classifier_oof", MODEL_KEYS)
def _(t):
    return G.classifier_oof(cut_lineage(z_frame(t)), QUARTERS[-4:], INPUTS)


@query("hurdle", MODEL_KEYS)
def _(t):
    train, valid = split(t)
    scored_rows = G.fit_hurdle(train, INPUTS).add(valid.select(*AU, "target", *INPUTS))
    return G.hurdle_combinations(scored_rows).select(*AU, "target", "pred_a", "pred_b", "pred_c", "pred_d", "pred_final")


@query("hurdle_combinations", AU, SCZ + """SELECT anchor_date, user_id, exp(p * a_amount_z) - 1 AS pred_a, p * (exp(a_amount_z) - 1) AS pred_b, exp(b_amount_z) - 1 AS pred_c,
 (exp(p * a_amount_z) - 1 + exp(b_amount_z) - 1) / 2 AS pred_d, exp(0.5 * b_amount_z + 0.5 * pow(p, 1.1) * a_amount_z) - 1 AS pred_final FROM zf""")
def _(t):
    return G.hurdle_combinations(z_frame(t), "p", "a_amount_z", "b_amount_z").select(*AU, "pred_a", "pred_b", "pred_c", "pred_d", "pred_final")


@query("transition_specialists", MODEL_KEYS)
def _(t):
    train, valid = split(t)
    return G.transition_specialists(train, INPUTS).add(valid.select(*AU, "was_active", "z_target", *INPUTS)).select(*AU, "z_target", "p_react", "p_churn", "p_buy", "prediction_z")


def valid_only(valid):
    return valid.select(*AU, "target", *INPUTS)


@query("cohort_specialist", MODEL_KEYS)
def _(t):
    train, valid = split(t)
    return G.cohort_specialist(train, valid_only(valid), INPUTS, borderline_weight=1.5).select(*AU, "target", "prediction_z")


@query("frequency_specialist", MODEL_KEYS)
def _(t):
    train, valid = split(t)
    return G.frequency_specialist(train, valid_only(valid), INPUTS).select(*AU, "target", "prediction_z")


@query("delta_regressor", MODEL_KEYS)
def _(t):
    train, valid = split(t)
    return G.delta_regressor(train, valid_only(valid), INPUTS).select(*AU, "target", "prediction_z")


@query("tweedie", MODEL_KEYS)
def _(t):
    train, valid = split(t, [*AU, "target", *INPUTS])  # read in full by each of its passes
    return G.tweedie(train, valid_only(valid), INPUTS).select(*AU, "target", "prediction_z")


@query("calibrate_isotonic", MODEL_KEYS)
def _(t):
    train, valid = split(t)
    return G.calibrate(train, valid.select(*AU, "p2", "will_buy"), "p2")


@query("calibrate_platt", MODEL_KEYS)
def _(t):
    train, valid = split(t)
    return G.calibrate(train, valid.select(*AU, "p2", "will_buy"), "p2", method="platt")


query("calibrate_knots", AU, SCZ + "SELECT anchor_date, user_id, CASE WHEN a_amount_z <= 1 THEN 0.2 WHEN a_amount_z <= 6 THEN 0.2 + (a_amount_z - 1) * ((5 - 0.2) / 5) WHEN a_amount_z <= 12 THEN 5 + (a_amount_z - 6) * ((11.5 - 5) / 6) ELSE 11.5 END AS z FROM zf")(
    lambda t: z_frame(t).select(*AU, G.knot_map(F.col("a_amount_z"), [(1, 0.2), (6, 5), (12, 11.5)]).alias("z")))
query("calibration_line", ())(lambda t: G.calibration_line(scored(t), "p2"))


@query("ridge_amount_stack", MODEL_KEYS)
def _(t):
    train, valid = split(t)
    return G.ridge_amount_stack(train, AMOUNT).add(valid.select(*AU, "was_active", "z_target", *AMOUNT)).select(*AU, "z_target", "conditional_z")


@query("soft_stack", MODEL_KEYS)
def _(t):
    train, valid = split(t)
    return valid.select(*AU, "will_buy", G.soft_stack(train, ["p", "p2"], F.col("will_buy")).probability().alias("p_stack"))


@query("gated_router", ("rule",))
def _(t):
    return G.gated_router(z_frame(t), "a_amount_z", "b_amount_z", "p", "p2")


# --- runs -----------------------------------------------------------------------------------

def fold_inputs(log, anchors):
    wide = W.aggregate(W.history(log, anchors, back=90, columns=W.FOLD_METRICS), [*W.window_agg_exprs(aggs=["sum"]), *W.fold_recency_exprs()])
    return W.fill(wide).select("anchor_date", "user_id", *INPUTS)


def direct_model(train, valid):
    return G.direct_regressor(train, INPUTS).add(valid, "prediction_z")


def naive_model(train, valid):
    return valid.withColumn("prediction_z", log_amount("gmv_sum_30d"))


@query("cross_validation_run", ("fold", "model", "anchor_date", "user_id"))
def _(t):
    return R.cross_validation_run(t.log, QUARTERS[-4:], fold_inputs, {"direct": direct_model, "naive": naive_model})


@query("cross_validation_summary", ("model",))
def _(t):
    return R.run_summary(R.cross_validation_run(t.log, QUARTERS[-4:], fold_inputs, {"direct": direct_model, "naive": naive_model}))


def specialist_bank(train, valid):
    """Specialists' outputs beside two stand-in models, as a prediction bank."""
    fitted = G.transition_specialists(train, INPUTS)
    return fitted.add(valid.select(*AU, "was_active", "will_buy", "z_target", "target", "transition_state", *INPUTS, *REACT, *CHURN, *AMOUNT)).drop("p_react", "p_churn", "p_buy", "prediction_z")


@query("two_run_validation", ("transition_state",))
def _(t):
    panel = cut_lineage(z_frame(t))
    _, scored_bank = R.two_run_validation(panel, QUARTERS[-2], QUARTERS[-1], specialist_bank, ["react_logit", "a_react_logit"], ["churn_logit", "a_churn_logit"],
                                          ["amount_z", "a_amount_z"])
    return R.validation_report(scored_bank)


@query("walk_forward_stack", MODEL_KEYS)
def _(t):
    return R.walk_forward_stack(z_frame(t), QUARTERS, ["p", "p2"], AMOUNT)


@query("promotion_gate", ())
def _(t):
    # two anchors are read, with the inputs of the weights
    last = F.col("anchor_date").isin([F.lit(a).cast("date") for a in QUARTERS[-2:]])
    z = cut_lineage(z_frame(t).where(last).select(*AU, "was_active", "z_target", *REACT, *CHURN, *AMOUNT, "direct_z"))
    at = lambda d: z.where(f"anchor_date = '{d}'")
    base, cand = (lambda d: at(d).drop("direct_z")), (lambda d: at(d).select(*AU, "direct_z"))
    m, v = QUARTERS[-2:]
    return R.promotion_gate(base(m), base(v), cand(m), cand(v), ["direct_z"], REACT, CHURN, AMOUNT, ["direct_z"])


@query("group_ablation", ("group",))
def _(t):
    train, valid = split(t)
    return R.group_ablation(G.direct_regressor(train, INPUTS), valid)


@query("importance_by_group", ("feature_group",))
def _(t):
    train, valid = split(t)
    return R.importance_by_group(G.direct_regressor(train, INPUTS), valid)
