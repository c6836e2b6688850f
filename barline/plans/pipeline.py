"""Whole jobs: preprocessing of a panel, import of bar files, and the complete experiment."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.operators import evaluate, forecast, models, panel, prepare, splits, validate
from barline.operators.features import FeatureSpec, engineer_features, training_rows
from barline.sources import bars as bar_source
from barline.sources import runs, sinks, store
from barline.sources.scratch import stage


@dataclass(frozen=True)
class PipelineConfig:
    test_size: float = 0.2
    validation_size: float = 0.2
    feature_window: int = 7
    prediction_horizon: int = 1
    scaling_method: str = "standard"
    outlier_threshold: float = 3.0
    fit_outliers_on: str = "train"
    max_features: int = 50
    model_types: tuple[str, ...] = models.MODEL_TYPES
    model_params: dict[str, dict] = field(default_factory=dict)
    cross_validation_folds: int = 5
    enable_tuning: bool = False  # search over folds before each fit: tuning_init trials spread out, then tuning_iterations that learn
    tuning_init: int = 5
    tuning_iterations: int = 20
    training_mode: str = "per_symbol"
    enable_ensemble: bool = True  # False: the first model type alone, without a band
    ensemble_method: str = "weighted_average"
    split_date: str | None = None
    random_state: int = 42

    @property
    def spec(self) -> FeatureSpec:
        return FeatureSpec(feature_window=self.feature_window, horizon=self.prediction_horizon)


@dataclass
class Prepared:
    """Scaled rows of all symbols with their split, and the features chosen per symbol."""

    frame: DataFrame
    selected: DataFrame
    spec: FeatureSpec
    scaler: DataFrame
    outliers: DataFrame

    def features_by_symbol(self) -> dict[str, list[str]]:
        """Chosen columns per symbol."""
        out: dict[str, list[str]] = {}
        for row in self.selected.orderBy("symbol", "position").select("symbol", "feature").toLocalIterator():
            out.setdefault(row.symbol, []).append(row.feature)
        return out

    def features_of_any(self) -> list[str]:
        """Columns that some symbol chose, for pooled models."""
        chosen = {r.feature for r in self.selected.select("feature").distinct().collect()}
        return [f for f in self.spec.names if f in chosen]

    def transform(self, features: DataFrame, threshold: float) -> DataFrame:
        """Apply the fitted outlier rule and scaler to other feature rows (forecast rows)."""
        clean = prepare.apply_outlier_stats(features, self.outliers, self.spec.names, threshold)
        return prepare.apply_scaler(clean, self.scaler, self.spec.names)


def preprocess(
    bars: DataFrame, config: PipelineConfig = PipelineConfig(), split_date: str | None = None, features: DataFrame | None = None,
) -> Prepared:
    """Features, usable rows, split, outliers, scaling, selection: every symbol at once.

    The rows after the windows and after the scaling are staged, because several aggregates and many fits read
    them; so are the fitted statistics (one row per symbol), which are what is saved and applied to forecasts.
    """
    spec = config.spec
    names = spec.names
    rows = training_rows(engineer_features(bars, spec) if features is None else features, spec)
    split_date = split_date or config.split_date
    if split_date:
        rows = splits.split_by_date(rows, split_date, config.validation_size)
    else:
        rows = splits.split_by_fraction(rows, config.test_size, config.validation_size)
    rows = stage(rows, "features")
    fitting = rows if config.fit_outliers_on == "all" else rows.where(F.col("split") == "train")
    outliers = stage(prepare.outlier_stats(fitting, names), "outlier-stats")
    clean = prepare.apply_outlier_stats(rows, outliers, names, config.outlier_threshold)
    scaler = stage(prepare.scaler_stats(clean.where(F.col("split") == "train"), names, config.scaling_method), "scaler-stats")
    scaled = prepare.apply_scaler(clean, scaler, names)
    frame = stage(scaled, "prepared")
    selected = stage(prepare.select_features(frame, names, config.max_features), "selected")
    return Prepared(frame, selected, spec, scaler, outliers)


def data_shapes(prepared: Prepared) -> DataFrame:
    """Rows per symbol and split, and the number of chosen features."""
    chosen = prepared.selected.groupBy("symbol").agg(F.count("*").alias("features"))
    return prepared.frame.groupBy("symbol", "split").agg(F.count("*").alias("rows")).join(chosen, "symbol")


def save_preprocessor(prepared: Prepared, path: str) -> None:
    """Fitted statistics and chosen features as tables."""
    prepared.scaler.write.mode("overwrite").parquet(f"{path}/scaler")
    prepared.outliers.write.mode("overwrite").parquet(f"{path}/outliers")
    prepared.selected.write.mode("overwrite").parquet(f"{path}/selected")


def load_preprocessor(spark: SparkSession, path: str, frame: DataFrame, spec: FeatureSpec) -> Prepared:
    read = spark.read.parquet
    return Prepared(frame, read(f"{path}/selected"), spec, read(f"{path}/scaler"), read(f"{path}/outliers"))


@dataclass
class ImportReport:
    jobs: DataFrame
    findings: DataFrame
    inserted: int


def import_bars(
    raw: DataFrame, target: store.BarTable, at: datetime, source: str = "csv_import", min_years: float = validate.MIN_YEARS,
    version: str | None = None, headers: DataFrame | None = None,
) -> ImportReport:
    """Validate all datasets at once, upsert the bars of those without an error, and log one job per dataset.

    Rows that become no bar (no price, no readable date, or an earlier version of the day) are counted as skipped; inserted
    and updated are counted by key. Of rows for the same day the one with the highest `version` (a column of
    raw) wins, or else the last one read (by `_rank` where raw has it). The target table must exist (see BarTable.create). `headers` (see read_by_header) lets every
    dataset be judged by the columns of its own files: one with a wrong header is a failed job, the others go on. Files are opened once: the raw rows
    are staged, with their rank, taken at the scan before any shuffle.
    """
    if version or bar_source.RANK not in raw.columns:
        raw = raw.withColumn(bar_source.RANK, F.col(version) if version else F.monotonically_increasing_id())
    scanned = stage(raw, "raw")
    raw = scanned.drop(bar_source.RANK)
    every = raw.select("dataset").distinct() if headers is None else headers.select("dataset")
    found = stage(validate.findings(raw, min_years, None if headers is None else every, headers), "findings")
    verdict = validate.verdicts(raw, found, every)
    absent = validate.missing_columns(raw)  # in no file at all
    ranked = scanned.withColumns({"version": F.col(bar_source.RANK), **{c: F.lit(None).cast("string") for c in absent}}).drop(bar_source.RANK)
    good = ranked.join(verdict.where("is_valid"), "dataset", "left_semi")
    incoming = stage(bar_source.latest_bars(bar_source.normalise(good, keep=("version",)), "version"), "incoming")
    added = target.upsert_counts(incoming, at)
    inserted = added.agg(F.coalesce(F.sum("inserted"), F.lit(0))).first()[0]
    period = incoming.groupBy("symbol").agg(F.min("date").alias("data_start_date"), F.max("date").alias("data_end_date"))

    messages = found.groupBy(F.upper("dataset").alias("symbol")).agg(
        *[F.sort_array(F.collect_list(F.when(F.col("severity") == s, F.col("message")))).alias(f"{s}s") for s in ("error", "warning")]
    )
    read = raw.groupBy("dataset").agg(F.count("*").alias("read"))
    processed = every.join(read, "dataset", "left").groupBy(F.upper("dataset").alias("symbol")).agg(
        F.coalesce(F.sum("read"), F.lit(0)).cast("bigint").alias("records_processed"))
    none = F.array().cast("array<string>")
    zero = F.lit(0).cast("bigint")
    counted = {"records_inserted": F.coalesce("inserted", zero), "records_updated": F.coalesce("updated", zero)}
    outcome = processed.join(messages, "symbol", "left").join(added, "symbol", "left").join(period, "symbol", "left").select(
        "symbol", F.coalesce("errors", none).alias("errors"), F.coalesce("warnings", none).alias("warnings"),
        "records_processed", *[v.alias(k) for k, v in counted.items()],
        (F.col("records_processed") - sum(counted.values(), zero)).alias("records_skipped"), "data_start_date", "data_end_date",
    )
    started = store.jobs_started(processed.select("symbol"), source, F.lit(at))
    events = started.unionByName(store.jobs_finished(started, outcome, F.lit(at) + F.expr("INTERVAL 1 SECOND")))
    return ImportReport(store.current_jobs(events), found, inserted)


@dataclass
class ExperimentResults:
    experiment_id: str
    prepared: Prepared
    panel: panel.TrainedPanel
    metrics: DataFrame
    comparison: DataFrame
    weights: DataFrame
    predictions: DataFrame
    summary: DataFrame
    performance: DataFrame


def experiment_id(symbols: Sequence[str], model_types: Sequence[str], at: datetime, config: PipelineConfig | None = None) -> str:
    """Readable start (first symbols and types), then a digest of all symbols, types and settings: experiments that
    begin in the same second don't share a name unless they are the same."""
    whole = json.dumps([list(symbols), list(model_types), asdict(config) if config else None], default=str, sort_keys=True)
    return "_".join(["exp", f"{at:%Y%m%d_%H%M%S}", *symbols[:3], *model_types[:2], hashlib.sha256(whole.encode()).hexdigest()[:8]])


def run_experiment(
    bars: DataFrame, config: PipelineConfig = PipelineConfig(), prediction_days: int = 30,
    out_dir: str | None = None, at: datetime | None = None,
) -> ExperimentResults:
    """Preprocess, train, compare, weigh, backtest the last `prediction_days` days of each series, summarise, save."""
    started = at or datetime.now()
    spec = config.spec
    features = stage(engineer_features(bars, spec), "all-features")
    prepared = preprocess(bars, config, features=features)
    pooled = config.training_mode == "pooled"

    tuning = panel.Tuning(config.tuning_init, config.tuning_iterations, config.cross_validation_folds or 5) if config.enable_tuning else None
    trained = panel.train_panel(
        prepared.frame, prepared.features_of_any() if pooled else prepared.selected, config.model_types, config.model_params,
        config.cross_validation_folds, seed=config.random_state, mode=config.training_mode, tuning=tuning,
    )
    if trained.fitted().isEmpty():
        raise RuntimeError(f"No model could be trained: {[tuple(r) for r in trained.failures.limit(20).collect()]}")
    fitted = stage(trained.predictions(prepared.frame), "fitted")
    metrics = evaluate.training_metrics(fitted)
    comparison = stage(evaluate.compare_models(metrics, trained.cv if config.cross_validation_folds else None), "comparison")
    weights = forecast.ensemble_weights(fitted.where(F.col("split") == "val"))

    ends = features.groupBy("symbol").agg(F.max("date").alias("last_date"))
    spine = forecast.date_spine(ends, F.date_sub("last_date", prediction_days - 1), F.col("last_date"))
    scaled = prepared.transform(features, config.outlier_threshold)
    known = forecast.asof_before(spine, scaled.select("symbol", "date", "close", "pos", *spec.names))
    known = stage(known.where(F.col("pos") >= config.feature_window), "forecast-rows")
    rows = trained.predictions(known, keep=("symbol", "date"))
    if config.enable_ensemble:
        combined = forecast.combine(rows, weights, config.ensemble_method).withColumn("model_used", F.lit("ensemble"))
    else:
        combined = forecast.first_model(rows, config.model_types)
    predictions = stage(forecast.prediction_table(
        forecast.with_actuals(combined, features.select("symbol", "date", "close"), config.prediction_horizon),
        config.prediction_horizon, F.col("model_used")), "predictions")
    predictions = forecast.with_errors(predictions)
    told = evaluate.prediction_summary(predictions, total=True).select(
        F.col("symbol").alias("of"), "total_predictions", "predictions_with_actuals", "mean_prediction", "mse", "mae")
    best = evaluate.best_models(comparison).select(F.col("symbol").alias("best_of"), F.col("model").alias("best_model"))
    overview, performance = evaluate.experiment_overview(comparison), evaluate.model_performance(comparison)
    summary = overview.join(told, overview["symbol"].eqNullSafe(told["of"]), "left").drop("of")
    summary = summary.join(best, F.col("symbol") == F.col("best_of"), "left").drop("best_of")
    names = sorted(r.symbol for r in trained.fitted().select("symbol").distinct().toLocalIterator())
    eid = experiment_id(["panel" if s == "*" else s for s in names], list(config.model_types), started, config)
    if out_dir:
        sinks.save_experiment(eid, comparison, summary, out_dir, performance)
        sinks.save_predictions(predictions, f"{out_dir}/forecasts/{eid}", weights, experiment_id=eid)
        runs.append(run_records(eid, config, comparison, started, trained, out_dir), f"{out_dir}/runs")
        trained.save(f"{out_dir}/models/{eid}")
    return ExperimentResults(eid, prepared, trained, metrics, comparison, weights, predictions, summary, performance)


def run_records(
    run_id: str, config: PipelineConfig, comparison: DataFrame, at: datetime, trained: panel.TrainedPanel | None = None, out_dir: str | None = None,
) -> DataFrame:
    """Run-log rows of an experiment: configuration, model metrics (keys <model>_<symbol>_<metric>), and of each model
    what was fitted (params), where it is (artifact), and what came of each step (status: finished, or the failure)."""
    params = runs.params_from_dict(comparison.sparkSession, run_id, {"experiment_id": run_id, **asdict(config)}, at)
    long = comparison.select(
        "symbol", "model",
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in comparison.columns if c not in ("symbol", "model")
        ])),
    )
    out = params.unionByName(runs.metric_rows(long, run_id, runs.key_of("model", "symbol", "metric"), "value", F.lit(at)))
    if trained is None:
        return out
    of = F.when(F.col("symbol") == "*", "panel").otherwise(F.col("symbol"))
    features = trained.chosen.select("symbol", F.to_json("names").alias("features"))
    own = trained.fitted().join(trained.params, ["symbol", "model"], "left").join(features, "symbol", "left")
    told = [("param", "params", F.col("params")), ("param", "features", F.col("features")), ("artifact", "model", F.lit(f"{out_dir}/models/{run_id}")),
            ("status", "fit", F.lit("finished"))]
    for kind, name, value in told:
        out = out.unionByName(runs.param_rows(own, run_id, runs.key_of("model", of, F.lit(name)), value, F.lit(at), kind))
    why = F.concat(F.lit("failed: "), "reason")
    return out.unionByName(runs.param_rows(trained.failures, run_id, runs.key_of("model", of, "step"), why, F.lit(at), "status"))
