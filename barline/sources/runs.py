"""Run records as long rows (run_id, kind, key, value, number, at); kind is param, metric, artifact or status."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType()),
    T.StructField("number", T.DoubleType()),
    T.StructField("at", T.TimestampType()),
])


def key_of(*parts: str | Column) -> Column:
    """Key with prefixes: parts joined by underscores, NULL parts left out."""
    return F.concat_ws("_", *[F.col(p) if isinstance(p, str) else p for p in parts])


def metric_rows(df: DataFrame, run_id: str | Column, key: Column, value: str, at: Column) -> DataFrame:
    """Metrics from a value column; missing values (NULL or NaN) are skipped."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).select(
        (F.lit(run_id) if isinstance(run_id, str) else run_id).alias("run_id"), F.lit("metric").alias("kind"),
        key.alias("key"), v.cast("string").alias("value"), v.alias("number"), at.alias("at"),
    )


def param_rows(df: DataFrame, run_id: str | Column, key: Column, value: Column, at: Column, kind: str = "param") -> DataFrame:
    """Parameters or artifacts as text; structured values are given as JSON by the caller (to_json)."""
    return df.select(
        (F.lit(run_id) if isinstance(run_id, str) else run_id).alias("run_id"), F.lit(kind).alias("kind"),
        key.alias("key"), value.cast("string").alias("value"), F.lit(None).cast("double").alias("number"), at.alias("at"),
    )


def params_from_dict(spark: SparkSession, run_id: str, params: Mapping[str, object], at) -> DataFrame:
    """Configuration values of one run (a fixed handful of rows)."""
    import json

    def text(v: object) -> str:
        return json.dumps(v) if isinstance(v, (dict, list, tuple)) else str(v)

    rows = [(run_id, "param", k, text(v), None, at) for k, v in params.items()]
    return spark.createDataFrame(rows, RUN_SCHEMA)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def runs_wide(log: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per run: start time and the asked metrics."""
    cells = [F.max(F.when((F.col("kind") == "metric") & (F.col("key") == m), F.col("number"))).alias(m) for m in metrics]
    return log.groupBy("run_id").agg(F.min("at").alias("started"), *cells)


def search_runs(runs: DataFrame, condition: str | None = None, limit: int = 100) -> DataFrame:
    """Runs that meet a SQL condition, newest first."""
    out = runs.where(F.expr(condition)) if condition else runs
    return out.orderBy(F.col("started").desc(), "run_id").limit(limit)


def best_runs(runs: DataFrame, metric: str = "test_mse", ascending: bool = True, top_k: int = 5) -> DataFrame:
    order = F.col(metric).asc() if ascending else F.col(metric).desc()
    return runs.where(F.col(metric).isNotNull()).orderBy(order, "run_id").limit(top_k)
