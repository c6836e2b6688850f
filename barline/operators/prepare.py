"""Outlier replacement, scaling and feature selection, fitted per symbol.

Fitted statistics are one wide aggregate per symbol (partial aggregation happens before the shuffle); applying
them is a join on the symbol, which Spark broadcasts as long as the statistics are below its size threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _fit_rows(frame: DataFrame, fit_on: str) -> DataFrame:
    if fit_on == "all":
        return frame
    if fit_on == "train":
        return frame.where(F.col("split") == "train")
    raise ValueError(f"Unknown fitting rows: {fit_on}")


def outlier_stats(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    kinds = {"mean": "avg", "std": "stddev_samp", "median": "median"}
    return frame.groupBy("symbol").agg(
        *[F.expr(f"{f}(`{c}`) AS `{c}__{name}`") for c in features for name, f in kinds.items()]
    )


def _per_feature(frame: DataFrame, joined: DataFrame, features: Sequence[str], pattern: str) -> DataFrame:
    """The columns of `frame` with `pattern`, a SQL text over {c}, in place of each feature."""
    names = set(features)
    return joined.selectExpr(*[
        f"{pattern.format(c=c)} AS `{c}`" if c in names else f"`{c}`" for c in frame.columns
    ])


def apply_outlier_stats(frame: DataFrame, stats: DataFrame, features: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """Values further than `threshold` sample deviations from the mean become the median."""
    far = f"abs(try_divide(`{{c}}` - `{{c}}__mean`, `{{c}}__std`)) > {float(threshold)!r}D"
    pattern = f"CASE WHEN {far} THEN `{{c}}__median` ELSE `{{c}}` END"
    return _per_feature(frame, frame.join(stats, "symbol", "left"), features, pattern)


def replace_outliers(
    frame: DataFrame, features: Sequence[str], threshold: float = 3.0, fit_on: str = "train"
) -> DataFrame:
    """Fit on the train rows, or with fit_on="all" on the whole series, and apply to every row."""
    return apply_outlier_stats(frame, outlier_stats(_fit_rows(frame, fit_on), features), features, threshold)


# Centre and spread of each scaling method.
SCALERS = {
    "standard": ("avg(`{c}`)", "stddev_pop(`{c}`)"),
    "minmax": ("min(`{c}`)", "max(`{c}`) - min(`{c}`)"),
    "robust": ("median(`{c}`)", "percentile(`{c}`, 0.75D) - percentile(`{c}`, 0.25D)"),
}


def scaler_stats(frame: DataFrame, features: Sequence[str], method: str = "standard") -> DataFrame:
    """Per symbol and feature a centre and a spread; a spread of zero counts as one."""
    if method not in SCALERS:
        raise ValueError(f"Unknown scaling method: {method}")
    aggs = []
    for c in features:
        centre, spread = (x.format(c=c) for x in SCALERS[method])
        aggs += [
            F.expr(f"{centre} AS `{c}__centre`"),
            F.expr(f"CASE WHEN min(`{c}`) = max(`{c}`) OR {spread} = 0 THEN 1D ELSE {spread} END AS `{c}__spread`"),
        ]
    return frame.groupBy("symbol").agg(*aggs)


def apply_scaler(frame: DataFrame, stats: DataFrame, features: Sequence[str], fill: bool = True) -> DataFrame:
    scaled = "(`{c}` - `{c}__centre`) / `{c}__spread`"
    pattern = f"coalesce({scaled}, 0D)" if fill else scaled
    return _per_feature(frame, frame.join(stats, "symbol", "left"), features, pattern)


def scale(
    frame: DataFrame, features: Sequence[str], method: str = "standard", fit_on: str = "train", fill: bool = True
) -> DataFrame:
    """Scale with statistics of the train rows; NULLs become 0 after scaling (skipped while fitting)."""
    return apply_scaler(frame, scaler_stats(_fit_rows(frame, fit_on), features, method), features, fill)


def f_scores(frame: DataFrame, features: Sequence[str], target: str = "target") -> DataFrame:
    """(symbol, position, feature, score): F statistic of the linear fit of the target on each feature.

    NULL for a constant feature. A perfect correlation scores +infinity. One wide aggregate, unpivoted after it.
    """
    aggs = [F.expr("count(*) AS _rows"), F.expr(f"stddev_pop(`{target}`) AS _y")]
    for c in features:
        aggs += [
            F.expr(f"covar_pop(`{c}`, `{target}`) AS `{c}__cov`"),
            F.expr(f"CASE WHEN min(`{c}`) < max(`{c}`) THEN stddev_pop(`{c}`) END AS `{c}__std`"),
        ]
    cells = ", ".join(
        f"named_struct('position', {i}, 'feature', '{c}', 'r2', pow(try_divide(`{c}__cov`, `{c}__std` * _y), 2))"
        for i, c in enumerate(features)
    )
    score = "CASE WHEN r2 >= 1 THEN double('Infinity') ELSE try_divide(r2, 1 - r2) * (_rows - 2) END AS score"
    return (
        frame.groupBy("symbol").agg(*aggs).selectExpr("symbol", "_rows", f"inline(array({cells}))")
        .selectExpr("symbol", "position", "feature", score)
    )


def top_features(scores: DataFrame, k: int = 50) -> DataFrame:
    """Best k features per symbol; NULL scores rank lowest, ties go to the later column."""
    rank = F.row_number().over(
        Window.partitionBy("symbol").orderBy(F.col("score").desc_nulls_last(), F.col("position").desc())
    )
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def select_features(frame: DataFrame, features: Sequence[str], k: int = 50, fit_on: str = "train") -> DataFrame:
    """(symbol, position, feature, score, rank) chosen on the fitting rows."""
    return top_features(f_scores(_fit_rows(frame, fit_on), features), min(k, len(features)))


def mask_features(frame: DataFrame, selected: DataFrame, features: Sequence[str]) -> DataFrame:
    """Keep one schema for all symbols: features a symbol did not select become NULL."""
    chosen = selected.groupBy("symbol").agg(F.collect_set("feature").alias("chosen"))
    joined = frame.join(chosen, "symbol", "left")
    return _per_feature(frame, joined, features, "CASE WHEN array_contains(chosen, '{c}') THEN `{c}` END")
