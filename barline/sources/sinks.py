"""Result sinks: predictions with a sidecar, experiment tables, metric tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.operators.evaluate import prediction_summary


def save_predictions(predictions: DataFrame, path: str, weights: DataFrame | None = None, **metadata: object) -> None:
    """CSV under <path>/predictions and, per symbol, summary, weights and metadata as JSON under <path>/metadata."""
    predictions.write.mode("overwrite").option("header", True).csv(f"{path}/predictions")
    prediction_sidecar(predictions, weights, **metadata).write.mode("overwrite").json(f"{path}/metadata")


def prediction_sidecar(predictions: DataFrame, weights: DataFrame | None = None, **metadata: object) -> DataFrame:
    summary = prediction_summary(predictions)
    stats = [c for c in summary.columns if c != "symbol"]
    side = summary.select("symbol", F.struct(*stats).alias("summary_stats"))
    if weights is not None:
        by_model = weights.groupBy("symbol").agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", "weight")))).alias("ensemble_weights")
        )
        side = side.join(by_model, "symbol", "left")
    facts: list[Column] = [F.lit(str(v)).alias(k) for k, v in metadata.items()]
    return side.withColumn("metadata", F.struct(*facts)) if facts else side


def save_experiment(experiment_id: str, comparison: DataFrame, summary: DataFrame, path: str, performance: DataFrame | None = None) -> None:
    """Comparison as CSV, summary and performance of each model as JSON, partitioned by experiment; saving an experiment again replaces it."""
    tables = [(comparison, "comparison"), (summary, "summary"), *([] if performance is None else [(performance, "performance")])]
    for df, name in tables:
        out = df.withColumn("experiment_id", F.lit(experiment_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("experiment_id")
        out.option("header", True).csv(f"{path}/{name}") if name == "comparison" else out.json(f"{path}/{name}")


def save_metrics(rows: DataFrame, path: str, name: str, at: datetime) -> None:
    rows.withColumn("run_ts", F.lit(f"{at:%Y-%m-%d %H:%M:%S}")).write.mode("append").option("header", True).csv(f"{path}/{name}")
