"""Forecast rows: ensembles, as-of joins, backtests over a date spine, next-value forecasts.

Predictions are long: (symbol, date, model, prediction).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z_95 = 1.96  # fixed value: half width of the confidence band in standard deviations

ASOF_SHIFT = 10  # an as-of slice is 2**10 days


def model_rows(frame: DataFrame, models: dict[str, str | Column], keep: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """Turn prediction columns into long rows; models without a value for a row are left out."""
    cells = [
        F.struct(F.lit(name).alias("model"), (F.col(c) if isinstance(c, str) else c).alias("prediction"))
        for name, c in models.items()
    ]
    return frame.select(*keep, F.inline(F.array(*cells))).where(F.col("prediction").isNotNull())


def ensemble_weights(predictions: DataFrame, method: str = "performance_based") -> DataFrame:
    """(symbol, model, weight) from validation predictions with `target`: inverse squared error or equal, summing to 1."""
    err = F.col("target") - F.col("prediction")
    if method == "performance_based":
        score = 1 / (F.avg(err * err) + F.lit(1e-10))
    elif method == "equal":
        score = F.lit(1.0)
    else:
        raise ValueError(f"no way to combine models is called {method}")
    scores = predictions.groupBy("symbol", "model").agg(F.count("*").alias("rows"), score.alias("score"))
    total = F.sum("score").over(Window.partitionBy("symbol"))
    return scores.select("symbol", "model", (F.col("score") / total).alias("weight"))


def combine(
    predictions: DataFrame, weights: DataFrame | None = None, method: str = "weighted_average",
    by: Sequence[str] = ("symbol", "date"),
) -> DataFrame:
    """One row per group: combined prediction, band of +-1.96 population deviations across models, model count.

    Models without a weight count nothing beside weighted ones; where no model has a weight, all count alike."""
    if method not in ("weighted_average", "simple_average"):
        raise ValueError(f"no way to combine models is called {method}")
    p = F.col("prediction")
    if method == "weighted_average" and weights is not None:
        predictions = predictions.join(weights, ["symbol", "model"], "left")
        w = F.coalesce(F.col("weight"), F.lit(0.0))
        value = F.when(F.sum(w) > 0, F.try_divide(F.sum(w * p), F.sum(w))).otherwise(F.avg(p))
    else:
        value = F.avg(p)
    spread = Z_95 * F.stddev_pop(p)
    return predictions.groupBy(*by).agg(
        value.alias("predicted_value"),
        (value - spread).alias("confidence_lower"),
        (value + spread).alias("confidence_upper"),
        F.count(p).alias("models"),
    )


def first_model(predictions: DataFrame, order: Sequence[str], by: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """One row per group: the prediction of the first model type in `order` that has one, without a band, and its name."""
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    known = predictions.where((place > 0) & F.col("prediction").isNotNull())
    first = F.min_by(F.struct(F.col("prediction").alias("predicted_value"), F.col("model").alias("model_used")), place)
    return known.groupBy(*by).agg(first.alias("first")).select(*by, "first.*")


def date_spine(symbols: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """(symbol, date) for every calendar day in [start, end]; columns of `symbols` may give the bounds."""
    first = F.lit(start).cast("date") if isinstance(start, str) else start
    last = F.lit(end).cast("date") if isinstance(end, str) else end
    return symbols.select("symbol", F.explode(F.sequence(first, last)).alias("date"))


def asof_before(spine: DataFrame, history: DataFrame) -> DataFrame:
    """For each spine row the last history row of the symbol with a strictly earlier date (NULLs if none).

    Spine and history are merged and swept in date order, in slices of 1,024 days. What a slice inherits from earlier
    ones is the last history row before it, found on a table with one row per slice. So no task sweeps a whole
    series. The matched row's columns keep their names, its date becomes `asof_date`.
    """
    payload = [c for c in history.columns if c not in ("symbol", "date")]
    bar = F.struct(F.col("date").alias("asof_date"), *payload)
    slice_of = F.shiftright(F.unix_date("date"), ASOF_SHIFT)
    extra = [c for c in spine.columns if c not in ("symbol", "date")]
    bars = history.select("symbol", "date", slice_of.alias("slice"), bar.alias("bar"))
    asked = spine.select("symbol", "date", slice_of.alias("slice"), F.struct(F.lit(True).alias("asked"), *extra).alias("ask"))

    merged = asked.unionByName(bars, allowMissingColumns=True)
    # At an equal date the question comes before the bar, which keeps the match strictly earlier.
    sweep = Window.partitionBy("symbol", "slice").orderBy("date", F.col("bar").isNotNull())
    inside = F.last("bar", ignorenulls=True).over(sweep.rowsBetween(Window.unboundedPreceding, 0))
    swept = merged.withColumn("match", inside).where(F.col("ask").isNotNull())

    ends = bars.groupBy("symbol", "slice").agg(F.max_by("bar", "date").alias("bar"))
    slices = asked.select("symbol", "slice").distinct().join(ends, ["symbol", "slice"], "full_outer")
    inherited = F.last("bar", ignorenulls=True).over(
        Window.partitionBy("symbol").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = slices.select("symbol", "slice", inherited.alias("carried"))
    return (
        swept.join(carried, ["symbol", "slice"], "left")
        .withColumn("found", F.coalesce("match", "carried"))
        .select("symbol", "date", *[F.col(f"ask.{c}") for c in extra], "found.*")
    )


def rows_before(spine: DataFrame, numbered: DataFrame, limit: int = 100) -> DataFrame:
    """For each spine date the last `limit` bars strictly before it (bounded range join by position).

    `numbered` carries `pos`. The as-of match gives the position of the newest bar; the wanted positions are
    expanded and joined by equality.
    """
    matched = asof_before(spine, numbered.select("symbol", "date", "pos"))
    wanted = matched.where(F.col("pos").isNotNull()).select(
        "symbol", F.col("date").alias("pred_date"),
        F.explode(F.sequence(F.greatest(F.col("pos") - (limit - 1), F.lit(1)), F.col("pos"))).alias("pos"),
    )
    return wanted.join(numbered, ["symbol", "pos"])


def with_actuals(predictions: DataFrame, bars: DataFrame, horizon: int = 1) -> DataFrame:
    """Attach the close found exactly `horizon` days after the prediction date as actual_value."""
    actual = bars.select(
        "symbol", F.date_sub("date", horizon).alias("date"), F.col("close").alias("actual_value")
    )
    return predictions.join(actual, ["symbol", "date"], "left")


def with_errors(predictions: DataFrame) -> DataFrame:
    """Adds absolute, squared and percentage error of each prediction; NULL without an actual value."""
    err = F.col("actual_value") - F.col("predicted_value")
    return predictions.withColumns({
        "absolute_error": F.abs(err), "squared_error": err * err, "percentage_error": F.abs(F.try_divide(err, F.col("actual_value"))) * 100})


def prediction_table(predictions: DataFrame, horizon: int = 1, model: str | Column = "ensemble") -> DataFrame:
    """Output columns of the prediction sink; the band is absent for a single model."""
    have = set(predictions.columns)
    empty = F.lit(None).cast("double")
    return predictions.select(
        "symbol", F.col("date").alias("timestamp"), "predicted_value",
        *[(F.col(c) if c in have else empty).alias(c) for c in ("actual_value", "confidence_lower", "confidence_upper")],
        (F.lit(model) if isinstance(model, str) else model).alias("model_used"),
        F.lit(horizon).alias("prediction_horizon"),
    )


def backtest(
    spine: DataFrame, features: DataFrame, bars: DataFrame, models: dict[str, str], weights: DataFrame | None = None,
    horizon: int = 1, min_rows: int = 7,
) -> DataFrame:
    """Predict every spine date from the last bar before it, combine the models, attach actuals.

    Features look only backwards, so they are computed once over the history instead of once per date.
    Dates with fewer than `min_rows` earlier bars are skipped.
    """
    columns = sorted(set(models.values()))
    known = asof_before(spine, features.select("symbol", "date", "pos", *columns))
    known = known.where(F.col("pos") >= min_rows)
    combined = combine(model_rows(known, models), weights)
    return prediction_table(with_actuals(combined, bars, horizon), horizon)


def latest_rows(frame: DataFrame, n: int = 1) -> DataFrame:
    """Last n rows of each symbol; `pos` and `n` of the frame make it a filter."""
    return frame.where(F.col("pos") > F.col("n") - n)


def last_row(frame: DataFrame) -> DataFrame:
    """Last row of each symbol without positions: one aggregate."""
    rest = [c for c in frame.columns if c != "symbol"]
    return frame.groupBy("symbol").agg(F.max_by(F.struct(*rest), "date").alias("row")).select("symbol", "row.*")


def next_value(
    features: DataFrame, models: dict[str, str], weights: DataFrame | None = None, horizon: int = 1
) -> DataFrame:
    """Forecast from the newest bar of each symbol; its timestamp is the last date plus the horizon."""
    latest = last_row(features)
    combined = combine(model_rows(latest, models), weights)
    return prediction_table(combined.withColumn("date", F.date_add("date", horizon)), horizon)


def chart_series(split_frame: DataFrame, predictions: DataFrame) -> DataFrame:
    """Actual and predicted value per row with its split and both cut positions."""
    return split_frame.select(
        "symbol", "date", "pos", "split", "train_end", "val_end", "close", F.col("target").alias("actual")
    ).join(predictions.select("symbol", "date", "prediction"), ["symbol", "date"], "left")
