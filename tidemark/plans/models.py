"""Forecast recipes on ``pyspark.ml`` learners: the shape of the pipelines, distributed fits."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Matrices
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import clip, log_amount, logit, sigmoid, total
from tidemark.functions.isotonic import interpolated, isotonic_blocks
from tidemark.functions.lineage import cut_lineage, stored
from tidemark.operators.scoring import Z_MAX, assemble_probability, factorised_z

TREES = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "seed": 42}


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature vector beside the other columns."""
    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(df)


@dataclass
class Scorer:
    """A fitted learner with the features it needs; ``probability`` picks the class-1 probability, ``bounds`` clip what comes out."""

    model: Model
    features: list[str]
    probability: bool = False
    bounds: tuple[float, float] | None = None

    def add(self, df: DataFrame, name: str) -> DataFrame:
        # the learner writes to columns of its own; columns of those names wait under another one
        own = [c for c in ("prediction", "probability", "rawPrediction") if c in df.columns]
        held = df.withColumnsRenamed({c: f"_held_{c}" for c in own})
        out = self.model.transform(assemble(held, self.features))
        value = vector_to_array("probability")[1] if self.probability else F.col("prediction")
        if self.bounds:
            value = clip(value, *self.bounds)
        kept = [F.col(f"_held_{c}").alias(c) if c in own else F.col(c) for c in df.columns if c != name]
        return out.select(*kept, value.cast("double").alias(name))


def _narrow(df: DataFrame, features: list[str], label: Column, weight: str | None) -> DataFrame:
    cols = [F.col(c).cast("double").alias(c) for c in features]
    return df.select(*cols, label.cast("double").alias("_y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"))


def least_squares() -> LinearRegression:
    return LinearRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=0.0, solver="normal")


def fit_regressor(train: DataFrame, features: list[str], label: Column, weight: str | None = None, learner: str = "trees", **trees) -> Scorer:
    """Boosted trees, or weighted least squares with ``learner="line"``."""
    fit = GBTRegressor(featuresCol="_x", labelCol="_y", weightCol="_w", **{**TREES, **trees}) if learner == "trees" else least_squares()
    return Scorer(fit.fit(assemble(_narrow(train, features, label, weight), features)), features)


def fit_classifier(train: DataFrame, features: list[str], label: Column, weight: str | None = None, learner: str = "trees", **trees) -> Scorer:
    """Boosted trees, or with ``learner="line"`` weighted least squares on 0 and 1, clipped to that range."""
    rows = assemble(_narrow(train, features, label, weight), features)
    if learner == "line":
        return Scorer(least_squares().fit(rows), features, bounds=(0.0, 1.0))
    learner = GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", **{**TREES, **trees})
    return Scorer(learner.fit(rows), features, probability=True)


def direct_regressor(train: DataFrame, features: list[str], target: str = "target", weight: str | None = None, **trees) -> Scorer:
    """Boosted trees on the log target."""
    return fit_regressor(train, features, log_amount(target), weight, **trees)


def buy_classifier(train: DataFrame, features: list[str], target: str = "target", weight: str | None = None, **trees) -> Scorer:
    return fit_classifier(train, features, (F.col(target) > 0), weight, **trees)


def classifier_oof(panel: DataFrame, valid_anchors: list[str], features: list[str], horizon: int = 30, target: str = "target", **trees) -> DataFrame:
    """Out-of-fold probabilities: every validation anchor is scored by a model of the anchors legal for it."""
    parts = None
    for v in valid_anchors:
        at = F.lit(v).cast("date")
        model = buy_classifier(panel.where(F.date_add("anchor_date", horizon) <= at), features, target, **trees)
        part = model.add(panel.where(F.col("anchor_date") == at).select("anchor_date", "user_id", target, *features), "p").select(
            "anchor_date", "user_id", target, "p")
        parts = part if parts is None else parts.unionByName(part)
    return parts


# --- hurdle ---------------------------------------------------------------------------------

@dataclass
class Hurdle:
    buys: Scorer
    amount: Scorer
    direct: Scorer

    def add(self, df: DataFrame) -> DataFrame:
        return self.direct.add(self.amount.add(self.buys.add(df, "p"), "z_cond"), "z_direct")


def fit_hurdle(train: DataFrame, features: list[str], target: str = "target", weight: str | None = None, **trees) -> Hurdle:
    """Classifier on everybody, regressor on buyers, direct regressor on everybody."""
    return Hurdle(buy_classifier(train, features, target, weight, **trees),
                  fit_regressor(train.where(F.col(target) > 0), features, log_amount(target), weight, **trees),
                  direct_regressor(train, features, target, weight, **trees))


def hurdle_combinations(df: DataFrame, p: str = "p", z: str = "z_cond", direct: str = "z_direct", blend: float = 0.5, alpha: float = 1.1) -> DataFrame:
    """A: expm1(p z), B: p expm1(z), C: direct, D: mean of A and C, and the final log-space mix."""
    money = lambda x: F.greatest(F.expm1(x), F.lit(0.0))
    a, c = money(F.col(p) * F.col(z)), money(F.col(direct))
    final = F.col(direct) * F.lit(1.0 - blend) + F.pow(F.col(p), F.lit(alpha)) * F.col(z) * F.lit(blend)
    return df.withColumns({"pred_a": a, "pred_b": F.col(p) * money(F.col(z)), "pred_c": c, "pred_d": (a + c) / F.lit(2.0), "pred_final": money(final)})


# --- specialists ----------------------------------------------------------------------------

@dataclass
class Specialists:
    react: Scorer
    churn: Scorer
    amount: Scorer

    def add(self, df: DataFrame, alpha: float = 1.1) -> DataFrame:
        """The three outputs, the assembled probability and the factorised prediction."""
        scored = self.amount.add(self.churn.add(self.react.add(df, "p_react"), "p_churn"), "amount_z")
        p = assemble_probability(F.col("was_active"), F.col("p_react"), F.col("p_churn"))
        out = scored.withColumns({"p_buy": p, "react_logit": logit("p_react", 1e-6), "churn_logit": logit("p_churn", 1e-6)})
        return out.withColumn("prediction_z", factorised_z(F.col("p_buy"), F.greatest("amount_z", F.lit(0.0)), alpha))


def transition_specialists(train: DataFrame, features: list[str], weight: str | None = None, **trees) -> Specialists:
    """Return on inactive users, leaving on active users, amount on buyers."""
    return Specialists(
        fit_classifier(train.where("was_active = 0"), features, F.col("will_buy"), weight, **trees),
        fit_classifier(train.where("was_active = 1"), features, 1 - F.col("will_buy"), weight, **trees),
        fit_regressor(train.where("will_buy = 1"), features, F.col("z_target"), weight, **trees),
    )


def cohort_specialist(train: DataFrame, valid: DataFrame, features: list[str], activity: str = "gmv_sum_90d", recent: str = "gmv_sum_30d",
                      target: str = "target", power: float = 1.0, borderline_weight: float = 1.0, **trees) -> DataFrame:
    """Active users: p(buy)^power times amount; inactive users: direct. Active users
    without a purchase in the recent window may weigh more in the classifier."""
    active = F.col(activity) > 0
    part = train.where(active).withColumn("_bw", F.when(F.col(recent) == 0, borderline_weight).otherwise(1.0))
    buys = buy_classifier(part, features, target, "_bw", **trees)
    amount = fit_regressor(part.where(F.col(target) > 0), features, log_amount(target), **trees)
    direct = direct_regressor(train.where(~active), features, target, **trees)
    hot = amount.add(buys.add(valid.where(active), "p"), "_z").withColumn("prediction_z", clip(F.pow("p", F.lit(power)) * F.col("_z"), 0, Z_MAX))
    cold = direct.add(valid.where(~active), "prediction_z").withColumn("prediction_z", clip("prediction_z", 0, Z_MAX))
    return hot.drop("p", "_z").unionByName(cold)


def frequency_specialist(train: DataFrame, valid: DataFrame, features: list[str], split: str = "to_ord_sum_90d", least: float = 2, target: str = "target", **trees) -> DataFrame:
    """One regressor for frequent buyers, one for the rest."""
    often = F.col(split) >= least
    parts = [direct_regressor(train.where(c), features, target, **trees).add(valid.where(c), "prediction_z") for c in (often, ~often)]
    return parts[0].unionByName(parts[1]).withColumn("prediction_z", clip("prediction_z", 0, Z_MAX))


def delta_regressor(train: DataFrame, valid: DataFrame, features: list[str], baseline: str = "gmv_sum_30d", target: str = "target", **trees) -> DataFrame:
    """Predict the log change against a baseline amount and add it back."""
    model = fit_regressor(train, features, log_amount(target) - log_amount(baseline), **trees)
    scored = model.add(valid, "_delta")
    return scored.withColumn("prediction_z", clip(F.col("_delta") + log_amount(baseline), 0, Z_MAX)).drop("_delta")


def tweedie(train: DataFrame, valid: DataFrame, features: list[str], target: str = "target", power: float = 1.5, ridge: float = 0.1) -> DataFrame:
    """Tweedie regression with log link on log features; the prediction is logged afterwards."""
    logs = [f"_log_{c}" for c in features]
    with_logs = lambda d: d.select("*", *[F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))).alias(n) for c, n in zip(features, logs)])
    learner = GeneralizedLinearRegression(featuresCol="_x", labelCol="_y", family="tweedie", variancePower=power, linkPower=0.0, regParam=ridge, maxIter=25)
    fit = learner.fit(assemble(_narrow(with_logs(train), logs, F.col(target) / F.lit(1000.0), None), logs))
    scored = Scorer(fit, logs).add(with_logs(valid), "_amount")
    return scored.withColumn("prediction_z", clip(F.log1p(F.col("_amount") * F.lit(1000.0)), 0, Z_MAX)).drop("_amount", *logs)


# --- calibration ----------------------------------------------------------------------------

def calibrate(train: DataFrame, df: DataFrame, score: str = "p", label: str = "will_buy", method: str = "isotonic", name: str = "p_calibrated") -> DataFrame:
    """Isotonic (linear between its blocks, constant outside the range seen) or Platt calibration. Equal scores are one weighted row of the fit.

    A null or NaN score has no isotonic value, and teaches nothing.
    """
    plain = F.col(score).cast("double") + F.lit(0.0)  # -0.0 and 0.0 are one score
    rows = df.withColumn("_s", plain)
    if method == "isotonic":
        known = ~F.isnan("value") & F.col("value").isNotNull()
        points = train.groupBy(plain.alias("value")).agg(F.avg(F.col(label).cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("w")).where(known)
        fitted = interpolated(rows.select(F.col("_s").alias("value")).where(known).distinct(), isotonic_blocks(points))
        out = rows.join(fitted.select(F.col("value").alias("_s"), F.col("fitted").alias("_fitted")), "_s", "left")
        return out.withColumn(name, F.when(F.col("_fitted").isNotNull(), clip("_fitted", 0, 1))).select(*[c for c in df.columns if c != name], name)
    if method != "platt":
        raise ValueError(f"unknown calibration method: {method}")
    by_label = train.groupBy(F.col(score).cast("double").alias("_s"), F.col(label).cast("double").alias("_y")).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w").fit(assemble(by_label, ["_s"]))
    return Scorer(model, ["_s"], probability=True).add(rows, name).select(*df.columns, name)


def calibration_line(df: DataFrame, score: str = "p", label: str = "will_buy", eps: float = 1e-6) -> DataFrame:
    """Slope and intercept of the label on the logit of the score; 1 and 0 when calibrated."""
    counts = df.groupBy(logit(score, eps).alias("_l"), F.col(label).cast("double").alias("_y")).agg(F.count(F.lit(1)).cast("double").alias("_w"))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=0.0, maxIter=100).fit(assemble(counts, ["_l"]))
    return df.sparkSession.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double")


def knot_map(z: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise-linear map through ``(from, to)`` knots, constant outside."""
    out = F.when(z <= knots[0][0], F.lit(float(knots[0][1])))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(z <= x1, F.lit(float(y0)) + (z - F.lit(float(x0))) * F.lit((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(float(knots[-1][1])))


# --- stacks ---------------------------------------------------------------------------------

@dataclass
class RidgeStack:
    scorer: Scorer
    alpha: float
    mse: float
    top: float
    amounts: list[str]

    def add(self, df: DataFrame, name: str = "conditional_z") -> DataFrame:
        wide = _with_interactions(df, self.amounts)
        return self.scorer.add(wide, name).withColumn(name, clip(name, 0, self.top)).select(*[c for c in df.columns if c != name], name)


def _with_interactions(df: DataFrame, amounts: list[str]) -> DataFrame:
    a = F.col("was_active").cast("double")
    return df.withColumn("_active", a).withColumns({f"_i{i}": F.col(c) * a for i, c in enumerate(amounts)})


def ridge(rows: DataFrame, label: str, alpha: float, n: int, std: float):
    """Least squares with penalty ``alpha``; the learner divides its loss by the number of
    rows and its penalty by the deviation of the label."""
    return LinearRegression(featuresCol="_x", labelCol=label, elasticNetParam=0.0, regParam=alpha * (std or 1.0) / max(n, 1),
                            standardization=False, solver="normal").fit(rows)


def ridge_amount_stack(train: DataFrame, amounts: list[str], target_z: str = "z_target", alphas=(0.01, 0.1, 1.0, 10.0, 100.0)) -> RidgeStack:
    """Ridge on amounts, activity and their products over buyers; the penalty with the least error wins."""
    names = [*amounts, "_active", *[f"_i{i}" for i in range(len(amounts))]]
    rows = cut_lineage(_narrow(_with_interactions(train.where("will_buy = 1"), amounts), names, F.col(target_z), None))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max("_y").alias("top"), F.stddev_pop("_y").alias("std")).first()
    best = None
    for alpha in alphas:
        fit = ridge(assemble(rows, names), "_y", alpha, stats["n"], stats["std"])
        mse = fit.summary.meanSquaredError
        if best is None or mse < best.mse:
            best = RidgeStack(Scorer(fit, names), alpha, mse, stats["top"], amounts)
    return best


@dataclass
class SoftStack:
    weights: dict[str, float]
    temperature: float
    bias: float

    def probability(self, eps: float = 1e-6) -> Column:
        z = sum((logit(c, eps) * F.lit(w) for c, w in self.weights.items()), F.lit(0.0))
        return sigmoid(z * F.lit(self.temperature) + F.lit(self.bias))


def soft_stack(train: DataFrame, probabilities: list[str], label: Column, eps: float = 1e-6) -> SoftStack:
    """Non-negative weights on the logits by log loss. The coefficients are split into
    weights that sum to one and a common temperature."""
    names = [f"_l{i}" for i in range(len(probabilities))]
    rows = train.select(*[logit(c, eps).alias(n) for c, n in zip(probabilities, names)], label.cast("double").alias("_y"))
    bounds = Matrices.dense(1, len(names), [0.0] * len(names))
    fit = LogisticRegression(featuresCol="_x", labelCol="_y", lowerBoundsOnCoefficients=bounds, maxIter=100).fit(assemble(rows, names))
    coefficients = [max(float(c), 0.0) for c in fit.coefficients]
    size = sum(coefficients)
    weights = [c / size for c in coefficients] if size > 0 else [1.0 / len(names)] * len(names)
    return SoftStack(dict(zip(probabilities, weights)), size, float(fit.intercept))


def moment_sums(values: list[Column]) -> list[Column]:
    """Sums of the products of 1 and ``values``, the upper triangle row by row."""
    row = [F.lit(1.0), *values]
    return [F.sum(x * y).alias(f"_s{i}_{j}") for i, x in enumerate(row) for j, y in enumerate(row) if i <= j]


def ridge_of_moments(moments: np.ndarray, alpha: float) -> tuple[list[float], float]:
    """Coefficients and intercept of ``ridge`` from summed products of 1, the inputs and the label."""
    n = moments[0, 0]
    if not n:
        raise ValueError("no rows to fit")
    mean = moments[0] / n
    spread = moments - n * np.outer(mean, mean)
    size = len(mean) - 2
    b = np.linalg.solve(spread[1:-1, 1:-1] + alpha * np.eye(size), spread[1:-1, -1])
    return b.tolist(), float(mean[-1] - mean[1:-1] @ b)


def gated_router(df: DataFrame, z_a: str, z_b: str, p_a: str, p_b: str, target_z: str = "z_target", folds: int = 5, grid: int = 101,
                 at_once: int = 4) -> DataFrame:
    """Two models combined by a global weight, by a probability gate, by a logistic gate
    per past state and by ridge (both out of fold), with oracle bounds. One row per rule.

    The rows are written once, in a folder per fold and state. One pass sums the moments of each folder, which give the global
    weight and the ridge of every fold; a gate reads the folders it learns from; one pass scores all rows.
    """
    number = lambda c: F.col(c).cast("double")
    rows = stored(df.select(
        F.pmod(F.xxhash64("user_id"), F.lit(folds)).cast("int").alias("_fold"), F.when(F.col("was_active") == 0, 0).when(F.col("was_active") == 1, 1).alias("_state"),
        "will_buy", "transition_state", number("was_active").alias("_act"), number(target_z).alias("_y"), number(z_a).alias("_a"), number(z_b).alias("_b"),
        number(p_a).alias("_p"), logit(p_a, 1e-6).alias("_la"), logit(p_b, 1e-6).alias("_lb")), "_fold", "_state").withColumn("_d", F.col("_b") - F.col("_a"))
    y, a, b, p = (F.col(c) for c in ("_y", "_a", "_b", "_p"))
    inputs = ["_la", "_lb", "_a", "_b", "_d", "_act"]
    fitted = [*map(F.col, inputs), y]
    unusable = F.greatest(*[F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 1).otherwise(0) for x in fitted])
    # the error of a global blend is a parabola in its weight, so three sums give the whole grid
    parts = rows.groupBy("_fold", "_state").agg(F.sum(unusable).alias("unusable"), F.sum((a - y) * (a - y)).alias("aa"), F.sum((a - y) * (b - a)).alias("ab"),
                                                F.sum((b - a) * (b - a)).alias("bb"), *moment_sums(fitted)).collect()
    if any(r["unusable"] for r in parts):
        raise ValueError("inputs and target of the router must be finite numbers")
    aa, ab, bb = (math.fsum(r[c] for r in parts) for c in ("aa", "ab", "bb"))
    weight = min((i / (grid - 1) for i in range(grid)), key=lambda w: aa + 2 * w * ab + w * w * bb)
    size = len(fitted) + 1
    moments = lambda keep: np.array([[sum(r[f"_s{min(i, j)}_{max(i, j)}"] for r in parts if keep(r)) for j in range(size)] for i in range(size)], dtype=float)
    lines = [ridge_of_moments(moments(lambda r: r["_fold"] != k), 100.0) for k in range(folds)]

    def fit(k: int, state: int) -> tuple:
        n = max(moments(lambda r: r["_fold"] != k and r["_state"] == state)[0, 0], 1)
        part = rows.where((F.col("_fold") != k) & (F.col("_state") == state)).select("will_buy", *inputs)
        gate = LogisticRegression(featuresCol="_x", labelCol="will_buy", regParam=10.0 / n, standardization=False).fit(assemble(part, inputs))
        return k, state, *lines[k], gate.coefficients.toArray().tolist(), float(gate.intercept)

    # the steps of a fit are short jobs, so some fits run at a time
    with ThreadPool(at_once) as pool:
        fits = pool.starmap(inheritable_thread_target(df.sparkSession)(fit), itertools.product(range(folds), (0, 1)), 1)
    models = df.sparkSession.createDataFrame(fits, "_fold int, _state int, _line array<double>, _line0 double, _gate array<double>, _gate0 double")
    scored = rows.join(F.broadcast(models), ["_fold", "_state"])
    linear = lambda name: total([F.col(name)[i] * F.col(c) for i, c in enumerate(inputs)]) + F.col(f"{name}0")
    g = F.when(F.col("_state") == 1, F.lit(1.0) - p).otherwise(p)
    mix = lambda w: a * (F.lit(1.0) - w) + b * w
    rules = {"model_a": a, "model_b": b, "global_blend": mix(F.lit(weight)), "probability_gate": mix(g), "state_gate": mix(sigmoid(linear("_gate"))),
             "ridge": F.greatest(linear("_line"), F.lit(0.0)), "hard_gate": F.when(g > 0.5, b).otherwise(a),
             "user_oracle": F.when((a - y) * (a - y) < (b - y) * (b - y), a).otherwise(b)}
    sse = scored.groupBy("transition_state").agg(F.count(F.lit(1)).alias("n"), *[F.sum((z - y) * (z - y)).alias(r) for r, z in rules.items()])
    long = sse.withColumn("state_oracle", F.least("model_a", "model_b")).unpivot(["transition_state", "n"], [*rules, "state_oracle"], "rule", "sse")
    return long.groupBy("rule").agg((F.sum("sse") / F.sum("n")).alias("mse"), F.sqrt(F.sum("sse") / F.sum("n")).alias("rmsle"))
