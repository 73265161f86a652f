"""Writing folds, snapshots, prediction banks and submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_no_overwrite(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet write that refuses an existing result root."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def spread_for_write(df: DataFrame, key: str) -> DataFrame:
    """One shuffle on ``(key, user block)`` so that each partition directory is
    written by many tasks and no task opens files of every directory."""
    return df.repartition(F.col(key), F.pmod(F.xxhash64("user_id"), F.lit(256)))


def write_folds(features: DataFrame, path: str) -> None:
    """Labelled folds and the unlabelled final fold in one partitioned table."""
    write_no_overwrite(spread_for_write(features, "fold"), path, ["fold"])


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    write_no_overwrite(spread_for_write(snapshots, "anchor_date"), path, ["anchor_date"])


def write_oof(fold_predictions: list[DataFrame], path: str) -> None:
    """Out-of-fold predictions of several folds as one matrix."""
    write_no_overwrite(oof_matrix(fold_predictions), path, ["fold"])


def oof_matrix(fold_predictions: list[DataFrame]) -> DataFrame:
    head, *rest = fold_predictions
    for df in rest:
        head = head.unionByName(df, allowMissingColumns=True)
    return head


def submission_rows(ordered: DataFrame) -> DataFrame:
    """``user_id, predict`` in template order (range-partitioned sort)."""
    return ordered.orderBy("position").select("user_id", "predict")


def write_predictions_csv(ordered: DataFrame, path: str) -> None:
    """Part files whose name order is the template order."""
    submission_rows(ordered).write.mode("errorifexists").option("header", True).csv(path)
