"""One model of a type for all symbols together, by Spark ML.

The label is the relative change of the close. Trees are Spark's: binned splits, a depth of at most 30 (also what "no limit" means), boosting without
ridge. A node needs `min_samples_split` rows to be split only as far as its leaves do: each gets half of them at least.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.operators.models import ModelSpec, create_model
from barline.operators.splits import expanding_folds
from barline.sources.scratch import stage

DEEPEST = 30
#: Rows of one part of the train table, once every core has one.
ROWS_OF_PART = 250_000


def estimator(spec: ModelSpec, seed: int) -> Estimator:
    """Reads `features`, predicts `target`."""
    p = spec.params
    columns = {"featuresCol": "features", "labelCol": "target"}
    if spec.model == "lasso":
        return LinearRegression(
            regParam=p["alpha"], elasticNetParam=1.0, standardization=False, maxIter=p["max_iter"], tol=p["tol"], **columns)
    tree = {"maxDepth": min(p["max_depth"] or DEEPEST, DEEPEST), "seed": seed, "maxBins": 32, **columns}
    if spec.model == "xgboost":
        return GBTRegressor(maxIter=p["n_estimators"], stepSize=p["learning_rate"], subsamplingRate=p["subsample"],
                            featureSubsetStrategy=str(p["colsample_bytree"]) if p["colsample_bytree"] < 1 else "all", **tree)
    tree["minInstancesPerNode"] = max(p["min_samples_leaf"], p["min_samples_split"] // 2)
    if spec.model == "decision_tree":
        return DecisionTreeRegressor(**tree)
    return RandomForestRegressor(numTrees=p["n_estimators"], featureSubsetStrategy="all", **tree)


def fit(rows: DataFrame, features: Sequence[str], spec: ModelSpec, seed: int) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), estimator(spec, seed)]).fit(rows)


def cross_validate(rows: DataFrame, features: Sequence[str], spec: ModelSpec, folds: int, seed: int) -> list[float]:
    """Negative mean squared error per expanding-window fold; rows carry pos and n of the train rows of their symbol."""
    marked = expanding_folds(rows, folds)

    def score(fold: int) -> float:
        part = marked.where(F.col("fold") == fold)
        model = fit(part.where(F.col("role") == "train"), features, spec, seed)
        err = F.col("prediction") - F.col("target")
        return -model.transform(part.where(F.col("role") == "test")).agg(F.avg(err * err)).first()[0]

    with ThreadPoolExecutor(max_workers=min(folds, 4)) as pool:
        return list(pool.map(score, range(folds)))


def dealt(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """The columns that fits read, staged in parts of equal size, at least one for every core: each level of each tree waits for its largest part.
    Rows are dealt by key and lie in order, so a fit can be repeated."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_OF_PART))
    keep = dict.fromkeys(c for c in ("symbol", "date", "pos", "n", "target", *features) if c in rows.columns)
    return stage(rows.select(*keep).repartition(parts, "symbol", "date").sortWithinPartitions("symbol", "date"), "dealt")


def train(
    rows: DataFrame, features: Sequence[str], specs: Mapping[str, Mapping], folds: int, seed: int, tuning=None,
) -> tuple[dict[str, PipelineModel], list[tuple], dict[str, dict]]:
    """Models by type, (symbol *, model, fold, score), parameters by type. Types are trained side by side: the steps of a boosted model are many and
    short, and leave cores to the others."""
    from barline.operators import search

    label = F.try_divide(F.col("target"), F.col("close")) - 1
    rows = rows.withColumn("target", label).where(F.col("target").isNotNull())
    n = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    counted = dealt(rows.drop("n").join(n, "symbol"), features)

    def one(kind: str, own: Mapping) -> tuple[PipelineModel, list[tuple], dict]:
        if tuning:
            own = search.tune_one(
                lambda p: sum(cross_validate(counted, features, create_model(kind, p), tuning.folds, seed)) / tuning.folds, kind,
                tuning.init_points, tuning.iterations, seed, own)
        spec = create_model(kind, own)
        scored = cross_validate(counted, features, spec, folds, seed) if folds else []
        return fit(counted, features, spec, seed), [("*", kind, i, s) for i, s in enumerate(scored)], dict(spec.params)

    with ThreadPoolExecutor(max_workers=max(len(specs), 1)) as pool:
        made = dict(zip(specs, pool.map(one, specs.keys(), specs.values())))
    return {k: m for k, (m, _, _) in made.items()}, [row for _, cv, _ in made.values() for row in cv], {k: told for k, (_, _, told) in made.items()}


def predictions(models: Mapping[str, PipelineModel], frame: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Long rows: keep, model, prediction (a price again)."""
    parts = []
    for kind, model in models.items():
        said = model.transform(frame).withColumn("prediction", F.col("close") * (1 + F.col("prediction")))
        parts.append(said.select(*keep, F.lit(kind).alias("model"), "prediction"))
    return reduce(DataFrame.unionByName, parts)
