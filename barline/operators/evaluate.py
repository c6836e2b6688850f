"""Metric computation over (dataset, y_real, y_pred) rows, model comparison and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions import metrics as M

DATASETS = ("train", "val", "test")
STRUCTURES = ("single_row", "multiple_rows")
# Keys of a metric request.
METADATA_KEYS = ("problem_type", "metrics", "results_file_name", "results_structure", "comment", "save")


class MetricInputError(ValueError):
    """Unusable metric input; `reason` names the broken rule."""

    def __init__(self, reason: str, message: str):
        super().__init__(f"{reason}: {message}")
        self.reason = reason


def check_request(metadata: dict) -> None:
    """Rules on the request alone: keys, layout, problem type, metric names."""
    for key in METADATA_KEYS:
        if key not in metadata:
            raise MetricInputError("metadata_key_missing", key)
    if metadata["results_structure"] not in STRUCTURES:
        raise MetricInputError("wrong_results_structure", metadata["results_structure"])
    if metadata["problem_type"] not in M.REGISTRY:
        raise MetricInputError("problem_type_not_implemented", metadata["problem_type"])
    for name in metadata["metrics"]:
        if name not in M.REGISTRY[metadata["problem_type"]]:
            raise MetricInputError("metric_not_implemented", name)


def pair_up(real: DataFrame, pred: DataFrame) -> DataFrame:
    """Match actual and predicted values on (dataset, id); unmatched ids keep one side NULL."""
    return real.join(pred, ["dataset", "id"], "full_outer")


def alignment(real: DataFrame, pred: DataFrame) -> DataFrame:
    """Per dataset: rows on each side, ids without a partner, missing values. One join, one aggregate."""
    left = real.withColumn("in_real", F.lit(1))
    right = pred.withColumn("in_pred", F.lit(1))
    return pair_up(left, right).groupBy("dataset").agg(
        F.count("in_real").alias("real_rows"),
        F.count("in_pred").alias("pred_rows"),
        F.count_if(F.col("in_real").isNull() | F.col("in_pred").isNull()).alias("unmatched"),
        F.count_if(F.col("in_real").isNotNull() & (F.col("y_real").isNull() | F.isnan("y_real"))).alias("real_missing"),
        F.count_if(F.col("in_pred").isNotNull() & (F.col("y_pred").isNull() | F.isnan("y_pred"))).alias("pred_missing"),
    )


def check_input(real: DataFrame, pred: DataFrame) -> None:
    """Rules on the data. With several faults the first dataset in order of its name decides, and in it the first rule."""
    for df, value in ((real, "y_real"), (pred, "y_pred")):
        if not isinstance(df, DataFrame):
            raise MetricInputError("wrong_type", f"{value} must come as a DataFrame")
        if not isinstance(df.schema[value].dataType, T.DoubleType):
            raise MetricInputError("wrong_values_type", f"{value} must be double")
    reason = (
        F.when(~F.coalesce(F.col("dataset").isin(*DATASETS), F.lit(False)), "wrong_dataset_name")
        .when((F.col("real_rows") == 0) | (F.col("pred_rows") == 0), "empty")
        .when(F.col("real_rows") != F.col("pred_rows"), "incompatible_lengths")
        .when(F.col("unmatched") > 0, "index_mismatch")
        .when((F.col("real_missing") > 0) | (F.col("pred_missing") > 0), "missing_values")
    )
    facts = alignment(real, pred).withColumn("reason", reason).agg(
        F.count("*").alias("datasets"),
        F.min(F.when(F.col("reason").isNotNull(), F.struct(F.coalesce("dataset", F.lit("")).alias("dataset"), "reason"))).alias("first"),
    ).first()
    if not facts.datasets:
        raise MetricInputError("empty", "no rows")
    if facts.first:
        raise MetricInputError(facts.first.reason, facts.first.dataset)


def metric_rows(
    pairs: DataFrame, metrics: Sequence[str], problem_type: str = "regression", by: Sequence[str] = ("dataset",)
) -> DataFrame:
    """One row per group, one column per metric."""
    known = M.REGISTRY[problem_type] | (M.TRAINING if problem_type == "regression" else {})
    real, pred = F.col("y_real").cast("double"), F.col("y_pred").cast("double")
    return pairs.groupBy(*by).agg(*[known[m](real, pred).alias(m) for m in metrics])


def single_row(rows: DataFrame, metrics: Sequence[str], comment: str = "", datasets: Sequence[str] = DATASETS) -> DataFrame:
    """Metrics of all datasets side by side: comment, <metric>_<dataset> ..."""
    cells = [
        F.max(F.when(F.col("dataset") == d, F.col(m))).alias(f"{m}_{d}") for d in datasets for m in metrics
    ]
    return rows.agg(F.lit(comment).alias("comment"), *cells)


def calculate_metrics(real: DataFrame, pred: DataFrame, metadata: dict) -> DataFrame:
    """Validate request and data, then compute the asked metrics per dataset in the asked layout."""
    check_request(metadata)
    check_input(real, pred)
    rows = metric_rows(pair_up(real, pred), metadata["metrics"], metadata["problem_type"])
    if metadata["results_structure"] == "multiple_rows":
        return rows
    present = [r.dataset for r in real.select("dataset").distinct().collect()]
    order = [d for d in DATASETS if d in present]
    return single_row(rows, metadata["metrics"], metadata["comment"], order)


def split_metrics(pairs: DataFrame, split: str | None = None) -> DataFrame:
    """mape and r2 per split (val is reported as validation), or of one split."""
    # Accepted names of a split; unknown names count as train.
    name = {"train": "train", "validation": "val", "val": "val", "test": "test"}.get(split or "", "train")
    rows = pairs if split is None else pairs.where(F.col("dataset") == name)
    label = F.when(F.col("dataset") == "val", "validation").otherwise(F.col("dataset"))
    return metric_rows(rows, ("mape", "r2")).withColumn("dataset", label)


def training_metrics(predictions: DataFrame, by: Sequence[str] = ("symbol", "model", "split")) -> DataFrame:
    """Long rows (symbol, model, split, metric, value) from columns target and prediction."""
    pairs = predictions.withColumnsRenamed({"target": "y_real", "prediction": "y_pred"})
    wide = metric_rows(pairs, tuple(M.TRAINING), by=by)
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in M.TRAINING]
    return wide.select(*by, F.inline(F.array(*cells)))


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold scores."""
    return scores.groupBy("symbol", "model").agg(
        F.avg("score").alias("cv_score_mean"), F.stddev_pop("score").alias("cv_score_std")
    )


def compare_models(metrics: DataFrame, cv: DataFrame | None = None) -> DataFrame:
    """One row per (symbol, model): test_* and val_* metrics and CV score, best test_mse first."""
    cells = [
        F.max(F.when((F.col("split") == s) & (F.col("metric") == m), F.col("value"))).alias(f"{s}_{m}")
        for s in ("test", "val") for m in M.TRAINING
    ]
    table = metrics.groupBy("symbol", "model").agg(*cells)
    if cv is not None:
        table = table.join(cv_summary(cv), ["symbol", "model"], "left")
    return table.orderBy("symbol", "test_mse", "model")


def best_models(comparison: DataFrame, metric: str = "test_mse", ascending: bool = True) -> DataFrame:
    """Per symbol the model with the best value of `metric` (ties: first by name)."""
    rest = [c for c in comparison.columns if c != "symbol"]
    key = F.col(metric) if ascending else -F.col(metric)
    pick = F.min_by(F.struct(*rest), F.struct(key, F.col("model")))
    return comparison.where(F.col(metric).isNotNull()).groupBy("symbol").agg(pick.alias("best")).select("symbol", "best.*")


def experiment_overview(comparison: DataFrame) -> DataFrame:
    """Models and mean test error per symbol, and over all symbols (symbol NULL)."""
    return comparison.rollup("symbol").agg(
        F.count_distinct("symbol").alias("symbols"),
        F.count("*").alias("models"),
        F.avg("test_mse").alias("avg_test_mse"),
        F.avg("test_mae").alias("avg_test_mae"),
        F.avg("test_r2").alias("avg_test_r2"),
        F.avg("test_mape_pct").alias("avg_test_mape_pct"),
    )


def model_performance(comparison: DataFrame) -> DataFrame:
    """Test errors of every (symbol, model), with its place among the symbol's models by squared error (ties: by name)."""
    order = Window.partitionBy("symbol").orderBy(F.col("test_mse").asc_nulls_last(), "model")  # a handful of models
    return comparison.select(
        "symbol", "model", *[f"test_{m}" for m in ("mse", "mae", "r2", "mape_pct")], F.row_number().over(order).alias("place"))


def prediction_summary(predictions: DataFrame, total: bool = False) -> DataFrame:
    """Per symbol (with `total` also over all, symbol NULL): number, number with actual, mean, deviation, extremes; errors over
    the rows with an actual."""
    p, a = F.col("predicted_value"), F.col("actual_value")
    return (predictions.rollup("symbol") if total else predictions.groupBy("symbol")).agg(
        F.count(p).alias("total_predictions"),
        F.count(a).alias("predictions_with_actuals"),
        F.avg(p).alias("mean_prediction"),
        F.stddev_pop(p).alias("std_prediction"),
        F.min(p).alias("min_prediction"),
        F.max(p).alias("max_prediction"),
        M.mse(a, p).alias("mse"),
        M.mae(a, p).alias("mae"),
    )
