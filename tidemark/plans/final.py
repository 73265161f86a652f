"""The final scoring run: fitted models and frozen weights written once, read back, and applied to an unlabelled anchor."""

from __future__ import annotations

import hashlib
import json

from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import logit
from tidemark.operators.index import join_template_ordered
from tidemark.operators.scoring import Meta, apply_meta
from tidemark.plans.models import Scorer, Specialists, fit_hurdle, hurdle_combinations, transition_specialists
from tidemark.sources.sinks import write_predictions_csv

ROLES = ("react", "churn", "amount")


def write_text(spark: SparkSession, text: str, path: str) -> str:
    """``text`` as a table of one row in whatever store the path names; gives its SHA-256. Refuses an existing path."""
    digest = hashlib.sha256(text.encode()).hexdigest()
    spark.createDataFrame([(text, digest)], "text string, sha256 string").coalesce(1).write.mode("errorifexists").parquet(path)
    return digest


def read_text(spark: SparkSession, path: str, sha256: str | None = None) -> str:
    """The text of :func:`write_text`; fails where it isn't the one that was pinned."""
    row = spark.read.parquet(path).first()
    if hashlib.sha256(row["text"].encode()).hexdigest() != row["sha256"] or sha256 not in (None, row["sha256"]):
        raise RuntimeError(f"{path} is not what was frozen")
    return row["text"]


def freeze_meta(spark: SparkSession, meta: Meta, path: str) -> str:
    return write_text(spark, meta.to_json(), path)


def frozen_meta(spark: SparkSession, path: str, sha256: str | None = None) -> Meta:
    return Meta.from_json(read_text(spark, path, sha256))


def save_specialists(spark: SparkSession, models: Specialists, path: str) -> None:
    for role in ROLES:
        scorer: Scorer = getattr(models, role)
        scorer.model.write().save(f"{path}/{role}/model")
        write_text(spark, json.dumps({"features": scorer.features, "probability": scorer.probability, "bounds": scorer.bounds}), f"{path}/{role}/inputs")


def load_specialists(spark: SparkSession, path: str) -> Specialists:
    found = {}
    for role in ROLES:
        inputs = json.loads(read_text(spark, f"{path}/{role}/inputs"))
        found[role] = Scorer(DefaultParamsReader.loadParamsInstance(f"{path}/{role}/model", spark), **inputs)  # by the class its metadata names
    return Specialists(**found)


def specialist_columns(models: Specialists, rows: DataFrame) -> DataFrame:
    """The outputs that a bank holds: two logits and the log amount. Labels are neither needed nor read."""
    scored = models.amount.add(models.churn.add(models.react.add(rows, "p_react"), "p_churn"), "amount_z")
    return scored.withColumns({"react_logit": logit("p_react", 1e-6), "churn_logit": logit("p_churn", 1e-6)}).drop("p_react", "p_churn")


def train_final(panel: DataFrame, scoring_anchor: str, features: list[str], path: str, horizon: int = 30, weight: str | None = None, **trees) -> int:
    """Fresh specialists on every anchor whose target has ended by the scoring anchor, saved at ``path``; gives the number of rows."""
    legal = panel.where(F.date_add("anchor_date", horizon) <= F.lit(scoring_anchor).cast("date"))
    n = legal.count()
    if not n:
        raise ValueError("no anchor has a known target at the scoring anchor")
    save_specialists(panel.sparkSession, transition_specialists(legal, features, weight, **trees), path)
    return n


def score_final(rows: DataFrame, models_path: str, meta_path: str, meta_sha256: str) -> DataFrame:
    """``rows`` (features, was_active and any other columns of the bank at one anchor) with the frozen weights' prediction."""
    spark = rows.sparkSession
    return apply_meta(specialist_columns(load_specialists(spark, models_path), rows), frozen_meta(spark, meta_path, meta_sha256))


def submission(scored: DataFrame, template: DataFrame) -> DataFrame:
    """(position, user_id, predict) in template order; fails inside the job on a user without a finite prediction of 0 or more."""
    ordered = join_template_ordered(template, scored.select("user_id", F.col("prediction").alias("predict")), "predict")
    fit = F.col("predict").isNotNull() & ~F.isnan("predict") & (F.col("predict") >= 0) & (F.col("predict") < float("inf"))
    told = F.concat(F.lit("no valid prediction for user "), F.col("user_id").cast("string"))
    return ordered.withColumn("predict", F.when(fit, F.col("predict")).otherwise(F.raise_error(told).cast("double")))


def final_run(panel: DataFrame, rows: DataFrame, template: DataFrame, scoring_anchor: str, features: list[str], meta: Meta, path: str, horizon: int = 30, **trees) -> DataFrame:
    """Fit, freeze, score and write: models, weights and the submission's part files below ``path``, which must not exist. Gives the submission."""
    spark = panel.sparkSession
    digest = freeze_meta(spark, meta, f"{path}/meta")
    train_final(panel, scoring_anchor, features, f"{path}/models", horizon, **trees)
    write_predictions_csv(submission(score_final(rows, f"{path}/models", f"{path}/meta", digest), template), f"{path}/submission")
    return spark.read.csv(f"{path}/submission", header=True, schema="user_id long, predict double")


def submission_job(panel: DataFrame, rows: DataFrame, template: DataFrame, features: list[str], path: str, target: str = "target", weight: str | None = None,
                   blend: float = 0.5, alpha: float = 1.1, **trees) -> DataFrame:
    """Hurdle on all rows of a labelled panel, log-space mix with the direct regressor on ``rows``, CSV in template order at ``path``.

    ``weight`` names a column of sample weights, see ``anchor_weights``. Gives the written submission.
    """
    scored = hurdle_combinations(fit_hurdle(panel, features, target, weight, **trees).add(rows), blend=blend, alpha=alpha)
    write_predictions_csv(submission(scored.select("user_id", F.col("pred_final").alias("prediction")), template), path)
    return panel.sparkSession.read.csv(path, header=True, schema="user_id long, predict double")
