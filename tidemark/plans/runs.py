"""Validation runs: a short driver loop over folds, every step a Spark job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import clip, count_where, log_amount
from tidemark.functions.lineage import cut_lineage
from tidemark.operators.anchors import anchor_table
from tidemark.operators.derived import feature_group
from tidemark.operators.index import append_channel
from tidemark.operators.labels import state_labels, transition_labels
from tidemark.operators.metrics import cv_summary, error_by_transition, paired_bootstrap, rmsle
from tidemark.operators.scoring import Meta, apply_meta, fit_meta_weights
from tidemark.plans.models import Scorer, SoftStack, ridge_amount_stack, soft_stack

KEYS = ["anchor_date", "user_id"]


def cross_validation_run(log: DataFrame, anchors: list[str], features_of: Callable[[DataFrame, DataFrame], DataFrame],
                         models: dict[str, Callable[[DataFrame, DataFrame], DataFrame]], users: DataFrame | None = None, horizon: int = 30) -> DataFrame:
    """Fold by fold: snapshot one horizon before the inference anchor with its known
    target, snapshot at the anchor, then every model fits on the first and predicts the
    second. Returns the bank ``(fold, anchor_date, user_id, model, target, prediction_z)``.

    ``features_of(log, anchors)`` gives features; a model maps (train, valid) to ``prediction_z``.
    """
    spark = log.sparkSession
    bank = None
    for i, a in enumerate(anchors):
        valid_day = F.lit(a).cast("date")
        pair = anchor_table(spark, [a]).select(F.explode(F.array(F.date_sub("anchor_date", horizon), F.col("anchor_date"))).alias("anchor_date"))
        labels = state_labels(log, pair, users, horizon=horizon).withColumn("target", F.col(f"future_gmv_{horizon}d"))
        both = cut_lineage(features_of(log, pair).join(labels, KEYS))
        train, valid = both.where(F.col("anchor_date") < valid_day), both.where(F.col("anchor_date") == valid_day)
        for name, model in models.items():
            part = model(train, valid).select(F.lit(f"F{i + 1}").alias("fold"), *KEYS, F.lit(name).alias("model"), "target", "z_target", "prediction_z")
            bank = part if bank is None else bank.unionByName(part)
    return bank


def fold_scores(bank: DataFrame) -> DataFrame:
    return rmsle(bank.withColumn("prediction", F.expm1("prediction_z")), ["model", "fold"])


def run_summary(bank: DataFrame) -> DataFrame:
    return cv_summary(fold_scores(bank))


def two_run_validation(panel: DataFrame, meta_anchor: str, valid_anchor: str, fit_bank: Callable[[DataFrame, DataFrame], DataFrame], react: list[str],
                       churn: list[str], amount: list[str], horizon: int = 30, **fit) -> tuple[Meta, DataFrame]:
    """Run A trains up to M and scores M; the meta weights fitted there are frozen. Run B
    trains up to V with fresh models and scores V, where the frozen weights are applied."""
    bank_at: dict[str, DataFrame] = {}
    for a in (meta_anchor, valid_anchor):
        day = F.lit(a).cast("date")
        train = panel.where(F.date_add("anchor_date", horizon) <= day)
        bank_at[a] = cut_lineage(fit_bank(train, panel.where(F.col("anchor_date") == day)))
    meta = fit_meta_weights(bank_at[meta_anchor], react, churn, amount, **fit)
    return meta, apply_meta(bank_at[valid_anchor], meta)


def validation_report(scored: DataFrame) -> DataFrame:
    """Error by transition state of a scored bank."""
    rows = scored if "transition_state" in scored.columns else transition_labels(scored)
    return error_by_transition(rows, [], "transition_state")


def walk_forward_stack(oof: DataFrame, anchors: list[str], probabilities: list[str], amounts: list[str], alpha: float = 1.0, first: int = 1) -> DataFrame:
    """For growing anchor lists: fit the stacks on the earlier out-of-fold rows, score the next anchor."""
    out = None
    rows = cut_lineage(oof)
    for i in range(first, len(anchors)):
        seen = rows.where(F.col("anchor_date").isin([F.lit(a).cast("date") for a in anchors[:i]]))
        ahead = rows.where(F.col("anchor_date") == F.lit(anchors[i]).cast("date"))
        probability = soft_stack(seen, probabilities, F.col("will_buy"))
        amount = ridge_amount_stack(seen, amounts)
        scored = amount.add(ahead).withColumn("p_buy", probability.probability())
        scored = scored.withColumn("prediction_z", F.pow("p_buy", F.lit(alpha)) * F.col("conditional_z"))
        part = scored.select(*KEYS, "will_buy", "z_target", "p_buy", "conditional_z", "prediction_z")
        out = part if out is None else out.unionByName(part)
    return out


def promotion_gate(base_m: DataFrame, base_v: DataFrame, candidate_m: DataFrame, candidate_v: DataFrame, columns: list[str], react: list[str],
                   churn: list[str], amount: list[str], direct: list[str] = (), repeats: int = 300, **fit) -> DataFrame:
    """Meta weights with and without the candidate columns, both fitted at M and compared at V."""
    plain = [c for c in direct if c in base_m.columns]
    before = apply_meta(base_v, fit_meta_weights(base_m, react, churn, amount, plain, **fit))
    bank_m, bank_v = (append_channel(b, c, columns) for b, c in ((base_m, candidate_m), (base_v, candidate_v)))
    after = apply_meta(bank_v, fit_meta_weights(bank_m, react, churn, amount, direct, **fit))
    pairs = before.select(*KEYS, F.expm1("z_target").alias("target"), F.col("prediction").alias("before")).join(
        after.select(*KEYS, F.col("prediction").alias("after")), KEYS)
    return paired_bootstrap(pairs, "before", "after", repeats=repeats)


def gate_report(before: DataFrame, after: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Error of two scored banks over all rows, by transition state and by part (return, leaving, amount), in one aggregate.

    Banks come from ``apply_meta``, with the same labels. Rows ``(section, part, n, before, after, delta)``: squared log errors, for
    return and leaving the log loss of the users they are for.
    """
    names = ["p_react", "p_churn", "conditional_z", "prediction_z"]
    both = before.select(*keys, "was_active", "will_buy", "z_target", *[F.col(c).alias(f"{c}_before") for c in names]).join(
        after.select(*keys, *[F.col(c).alias(f"{c}_after") for c in names]), keys)
    active, buys, z = F.col("was_active") == 1, F.col("will_buy") == 1, F.col("z_target")
    square = lambda c: lambda side: (F.col(f"{c}_{side}") - z) * (F.col(f"{c}_{side}") - z)

    def loss(c: str, y: Column) -> Callable[[str], Column]:
        p = lambda side: clip(F.col(f"{c}_{side}"), 1e-6, 1 - 1e-6)
        return lambda side: -F.when(y, F.log(p(side))).otherwise(F.log(F.lit(1.0) - p(side)))

    states = {f"{a}{b}": (F.col("was_active") == a) & (F.col("will_buy") == b) for a in (0, 1) for b in (0, 1)}
    parts = [("all", "all", F.lit(True), square("prediction_z")), *[("state", s, cond, square("prediction_z")) for s, cond in states.items()],
             ("part", "react", ~active, loss("p_react", buys)), ("part", "churn", active, loss("p_churn", ~buys)), ("part", "amount", buys, square("conditional_z"))]
    sums = both.agg(*[x for i, (_, _, cond, e) in enumerate(parts) for x in (
        count_where(cond).alias(f"n{i}"), F.avg(F.when(cond, e("before"))).alias(f"b{i}"), F.avg(F.when(cond, e("after"))).alias(f"a{i}"))])
    rows = F.inline(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(part).alias("part"), F.col(f"n{i}").alias("n"), F.col(f"b{i}").alias("before"), F.col(f"a{i}").alias("after"))
                              for i, (section, part, _, _) in enumerate(parts)]))
    return sums.select(rows).withColumn("delta", F.col("after") - F.col("before"))


def group_ablation(model: Scorer, df: DataFrame, groups: dict[str, list[str]] | None = None, target: str = "target") -> DataFrame:
    """RMSLE with the features of one group set to zero, against all features."""
    if groups is None:
        groups = {}
        for c in model.features:
            groups.setdefault(feature_group(c), []).append(c)
    rows = cut_lineage(df.select("user_id", target, *model.features))
    parts = None
    for name, zeroed in {"all_features": [], **groups}.items():
        hidden = rows.select("user_id", target, *[F.lit(0.0).alias(c) if c in zeroed else F.col(c) for c in model.features])
        scored = model.add(hidden, "_z").withColumn("group", F.lit(name))
        part = scored.select("group", target, "_z")
        parts = part if parts is None else parts.unionByName(part)
    e = F.greatest(F.col("_z"), F.lit(0.0)) - log_amount(target)
    per = parts.groupBy("group").agg(F.sqrt(F.avg(e * e)).alias("rmsle"))
    base = per.where("group = 'all_features'").select(F.col("rmsle").alias("_base"))
    return per.crossJoin(F.broadcast(base)).select("group", "rmsle", (F.col("rmsle") - F.col("_base")).alias("delta_rmsle"))


def importance_by_group(model: Scorer, df: DataFrame) -> DataFrame:
    """Feature importances of a tree model summed by feature group."""
    values = model.model.featureImportances.toArray()
    rows = [(c, feature_group(c), float(v)) for c, v in zip(model.features, values)]
    per = df.sparkSession.createDataFrame(rows, "feature string, feature_group string, importance double")
    return per.groupBy("feature_group").agg(F.count(F.lit(1)).alias("n_features"), F.sum("importance").alias("importance"))
