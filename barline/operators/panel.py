"""Models of every series of a panel, as tables.

A series has one row per symbol and date, so a century of it is under 40,000 rows: the chosen features of a series are packed into one row, and each
task takes one series and one piece of work (a tree, some trees of a forest, a boosted model, a fold of one of these). Linear models come from
moments instead (lasso.py). Spark deals the pieces out, adds up what the parts of a forest say, and scores. The number of jobs depends
neither on the number of symbols nor of models.

The node table has one row per tree node or coefficient: symbol, model, tree, node, depth, feature, threshold, low, high (children),
value, rows, gain. Leaves and intercepts have no feature. A tree says its leaf's value; a forest the mean of its trees, a boosted
model their sum, a linear model the sum of value times feature.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from barline.functions import metrics as M
from barline.operators import lasso, pooled, trees
from barline.operators.models import DEFAULT_PARAMS, MODEL_TYPES, SEED, create_model
from barline.sources.scratch import stage

NODES = ("symbol string, model string, tree int, node long, depth int, feature string, threshold double, low long, high long, value double, "
         "rows long, gain double")
FAILED = "symbol string, model string, step string, reason string"
#: Trees of a forest that one task grows; a node's number starts with that of its part.
TREES_OF_PART, PART_SHIFT = 25, 32
#: Roles of rows in a packed series.
TRAIN, OTHER = 0, 1


def chosen_features(rows: DataFrame, features: Mapping[str, Sequence[str]] | Sequence[str] | DataFrame) -> DataFrame:
    """symbol, names. A DataFrame has symbol, position, feature; a list holds for every symbol of rows."""
    if isinstance(features, DataFrame):
        return features.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("position", "feature"))).alias("f")).select(
            "symbol", F.col("f.feature").alias("names"))
    spark = rows.sparkSession
    if isinstance(features, Mapping):
        return spark.createDataFrame([(s, list(f)) for s, f in features.items()], "symbol string, names array<string>")
    return rows.select("symbol").distinct().withColumn("names", F.array(*[F.lit(f) for f in features]))


def pack(rows: DataFrame, chosen: DataFrame, columns: Sequence[str]) -> DataFrame:
    """symbol, names, n, x (features x rows), y, pos, role (of rows): one row per symbol, in the order of pos. rows: symbol, pos, role, target
    and the columns that symbols choose from."""
    def build(key: tuple, own: pa.Table, names: pa.Table) -> pa.Table:
        own, chosen_ = own.sort_by("pos"), (names.column("names")[0].as_py() if names.num_rows else [])
        if not own.num_rows or not chosen_:
            return schema.empty_table()
        x = np.stack([own.column(c).to_numpy().astype(float) for c in chosen_])
        return pa.table({
            "symbol": [key[0].as_py()], "names": [chosen_], "n": [own.num_rows], "x": [x.tobytes()], "y": [own.column("target").to_numpy().astype(float).tobytes()],
            "pos": [own.column("pos").to_numpy().astype(np.int64).tobytes()], "role": [own.column("role").to_numpy().astype(np.int8).tobytes()]}, schema=schema)

    schema = pa.schema([("symbol", pa.string()), ("names", pa.list_(pa.string())), ("n", pa.int64()), *[(c, pa.binary()) for c in ("x", "y", "pos", "role")]])
    thin = rows.select("symbol", F.col("pos").cast("long").alias("pos"), F.col("role").cast("int").alias("role"), F.col("target").cast("double").alias("target"), *[
        F.col(f"`{c}`").cast("double").alias(c) for c in columns if c not in ("pos", "role", "target")])
    packed = thin.groupBy("symbol").cogroup(chosen.groupBy("symbol")).applyInArrow(
        build, "symbol string, names array<string>, n long, x binary, y binary, pos binary, role binary")
    return stage(packed, "packed")


@dataclass
class Series:
    """A packed series inside a task."""

    x: np.ndarray
    y: np.ndarray
    pos: np.ndarray
    role: np.ndarray
    names: list[str]

    @staticmethod
    def read(row: Mapping) -> Series:
        n = row["n"]
        return Series(np.frombuffer(row["x"]).reshape(-1, n), np.frombuffer(row["y"]), np.frombuffer(row["pos"], np.int64), np.frombuffer(row["role"], np.int8), row["names"])

    def train(self, fold: int, folds: int) -> np.ndarray:
        """Rows that a fold learns from; fold -1: all train rows."""
        n = int((self.role == TRAIN).sum())
        return (self.role == TRAIN) & ((self.pos <= n - (folds - fold) * (n // (folds + 1))) if fold >= 0 else True)

    def test(self, fold: int, folds: int) -> np.ndarray:
        """Rows that a fold is scored on; fold -1: the rows that aren't train rows."""
        if fold < 0:
            return self.role == OTHER
        n = int((self.role == TRAIN).sum())
        start, size = n - (folds - fold) * (n // (folds + 1)), n // (folds + 1)
        return (self.role == TRAIN) & (self.pos > start) & (self.pos <= start + size)


def _most_rounds(sets: list[dict]) -> dict:
    """Sets of boosted models differ in their rounds alone."""
    return max(sets, key=lambda p: p["n_estimators"])


def fit_trees(model: str, x: np.ndarray, y: np.ndarray, sets: list[dict], part: int, seed: int) -> trees.Nodes:
    """One fit that holds every parameter set: the deepest, the most trees, the least rows to split."""
    depth = None if any(p["max_depth"] is None for p in sets) else max(p["max_depth"] for p in sets)
    if model == "xgboost":
        return trees.boosted_together([(x, y, _most_rounds(sets))], seed)[0]
    least, leaf = min(p["min_samples_split"] for p in sets), sets[0]["min_samples_leaf"]
    if model == "decision_tree":
        return trees.decision_tree(x, y, depth, least, leaf)
    last = min((part + 1) * TREES_OF_PART, max(p["n_estimators"] for p in sets))
    return trees.forest(x, y, range(part * TREES_OF_PART, last), depth, least, leaf, seed)


def said_by(model: str, nodes: trees.Nodes, x: np.ndarray, sets: list[dict]) -> list[tuple[np.ndarray, int]]:
    """For each set, the sum of what its trees say, and how many of them count in its mean."""
    if model == "xgboost":
        values = trees.leaf_values(nodes, x)
        return [(values[:p["n_estimators"] + 1].sum(axis=0), 1) for p in sets]
    every = int(nodes.tree.max()) + 1
    return trees.sums_of_limits(nodes, x, [(p["max_depth"], p["min_samples_split"], p["n_estimators"] if model == "random_forest" else every) for p in sets])


def moments_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    rows = np.concatenate((np.ones((1, len(y))), x, y[None, :]))
    return rows @ rows.T


def _fit_lasso(x: np.ndarray, y: np.ndarray, sets: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    sums = moments_of(x, y)
    w, b = zip(*lasso.descend_together([(sums, p["alpha"], p["max_iter"], p["tol"] * 1e-5) for p in sets]))
    return np.stack(w), np.array(b)


def _pieces(asked: DataFrame, packed: DataFrame, folds: int) -> DataFrame:
    """One row per series and piece of work: symbol, model, sets, trials, fold, part and the packed series. asked: symbol, model, trial, params, share."""
    trees_ = F.coalesce(F.get_json_object("params", "$.n_estimators").cast("int"), F.lit(1))
    grouped = asked.groupBy("symbol", "model", "share").agg(
        F.sort_array(F.collect_list(F.struct("trial", "params"))).alias("sets"), F.max(trees_).alias("most"))
    parts = F.when(F.col("model") == "random_forest", F.expr(f"(most + {TREES_OF_PART - 1}) div {TREES_OF_PART}")).otherwise(1)
    pieces = grouped.withColumn("part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))).withColumn(
        "fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))) if folds else F.lit(-1))
    pieces = stage(pieces.drop("most", "share"), "pieces")
    number = pieces.count()
    wide = min(number, 4 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return pieces.join(packed, "symbol").repartition(max(wide, 1))


NODE_ROWS = pa.schema([
    ("symbol", pa.string()), ("model", pa.string()), ("tree", pa.int32()), ("node", pa.int64()), ("depth", pa.int32()), ("feature", pa.string()),
    ("threshold", pa.float64()), ("low", pa.int64()), ("high", pa.int64()), ("value", pa.float64()), ("rows", pa.int64()), ("gain", pa.float64()),
    ("reason", pa.string())])
TOLD_ROWS = pa.schema([
    ("symbol", pa.string()), ("model", pa.string()), ("trial", pa.int32()), ("fold", pa.int32()), ("pos", pa.int64()), ("actual", pa.float64()),
    ("said", pa.float64()), ("count", pa.int32()), ("reason", pa.string())])
SCORE_ROWS = pa.schema([("symbol", pa.string()), ("model", pa.string()), ("trial", pa.int32()), ("fold", pa.int32()), ("score", pa.float64())])


def _table(schema: pa.Schema, **columns) -> pa.Table:
    """Columns by name: arrays, or one value for all rows; absent ones are null."""
    size = max([len(v) for v in columns.values() if isinstance(v, (np.ndarray, list))], default=1)
    return pa.table([
        pa.array(v, f.type, from_pandas=True) if isinstance(v := columns.get(f.name), (np.ndarray, list)) else pa.array([v] * size, f.type) for f in schema], schema=schema)


def _worked(pieces: DataFrame, work: Callable, folds: int, schema: pa.Schema, seed: int) -> DataFrame:
    """work(row, series, sets, nodes) gives columns, or raises what is wrong with the model: that becomes a row with a reason. What is wrong with
    the cluster is raised. nodes: the fit, where boosted models of small series were fitted together; or else None."""
    def told(row: Mapping, asked: Callable) -> Iterator[pa.RecordBatch]:
        try:
            out = asked()
        except (ValueError, FloatingPointError, np.linalg.LinAlgError) as e:
            out = [{"reason": str(e)}]
        for part in out:
            yield from _table(schema, symbol=row["symbol"], model=row["model"], **part).to_batches()

    def read(row: Mapping) -> tuple[Series, list[tuple[int, dict]]]:
        series = Series.read(row)
        if not np.isfinite(series.x).all() or not np.isfinite(series.y).all():
            raise ValueError("features and target must be numbers in every row")
        if not series.train(row["fold"], folds).any():
            raise ValueError("no rows to learn from")
        return series, [(s["trial"], json.loads(s["params"])) for s in row["sets"]]

    def together(waiting: list[tuple]) -> Iterator[pa.RecordBatch]:
        learn = [series.train(row["fold"], folds) for row, series, _ in waiting]
        fits = trees.boosted_together([(s.x[:, m], s.y[m], _most_rounds([p for _, p in sets])) for (_, s, sets), m in zip(waiting, learn)], seed)
        for (row, series, sets), nodes in zip(waiting, fits):
            yield from told(row, lambda: work(row, series, sets, nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, cells = [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["model"] != "xgboost":
                    yield from told(row, lambda: work(row, *read(row), None))
                    continue
                try:
                    waiting.append((row, *read(row)))
                except ValueError as e:
                    yield from told(row, lambda: [{"reason": str(e)}])
                    continue
                cells += waiting[-1][1].x.size
                if cells >= trees.BOOSTED_TOGETHER:
                    yield from together(waiting)
                    waiting, cells = [], 0
        if waiting:
            yield from together(waiting)

    return pieces.mapInArrow(run, from_arrow_schema(schema))


def lasso_columns(names: Sequence[str], w: np.ndarray, b: float, rows: int) -> dict:
    """Columns of the node table of a linear model."""
    return {"tree": 0, "node": np.arange(len(w) + 1), "depth": 0, "feature": [*names, None], "value": np.append(w, b), "rows": rows, "gain": 0.0}


def node_columns(names: Sequence[str], nodes: trees.Nodes, part: int = 0) -> dict:
    """Columns of the node table of trees; children that aren't there are -1."""
    table = nodes.table()
    for c in ("node", "low", "high"):
        table[c] = np.where(table[c] >= 0, table[c] + (part << PART_SHIFT), -1).astype(np.int64)
    return table | {"feature": np.array([*names, None], object)[table["feature"]].tolist()}


def fit_nodes(packed: DataFrame, asked: DataFrame, seed: int = SEED) -> DataFrame:
    """The node table of the asked models (symbol, model, trial, params, share), fitted on all train rows, with `reason` where one failed."""
    def work(row, series, sets, nodes):
        learn, model = series.train(-1, 0), row["model"]
        x, y = series.x[:, learn], series.y[learn]
        if model == "lasso":
            w, b = _fit_lasso(x, y, [p for _, p in sets])
            return [lasso_columns(series.names, w[0], b[0], len(y))]
        return [node_columns(series.names, nodes or fit_trees(model, x, y, [p for _, p in sets], row["part"], seed), row["part"])]

    fitted = _worked(_pieces(asked, packed, 0), work, 0, NODE_ROWS, seed)
    return fitted.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in ("low", "high")})


def _error(metric: str):
    said, real = F.col("said"), F.col("actual")
    return F.avg((said - real) * (said - real)) if metric == "mse" else M.mape(real, said)


def scores(packed: DataFrame, asked: DataFrame, folds: int, metric: str = "mse", seed: int = SEED) -> DataFrame:
    """symbol, model, trial, fold, score (the negative error) of every asked set on every fold; folds 0: on the rows that aren't train rows.

    Sets of one share come from one fit per fold. A set without a score failed; `reason` says why."""
    def work(row, series, sets, nodes):
        learn, held = series.train(row["fold"], folds), series.test(row["fold"], folds)
        x, y, model = series.x[:, learn], series.y[learn], row["model"]
        if not held.any():
            raise ValueError("no rows to be scored on")
        out, there = [], series.x[:, held]
        if model == "lasso":
            told = [(v, 1) for v in (lambda w, b: w @ there + b[:, None])(*_fit_lasso(x, y, [p for _, p in sets]))]
        else:
            nodes = nodes or fit_trees(model, x, y, [p for _, p in sets], row["part"], seed)
            told = said_by(model, nodes, there, [p for _, p in sets])
        for (trial, _), (said, count) in zip(sets, told):
            if count:
                out.append({"trial": trial, "fold": row["fold"], "pos": series.pos[held], "actual": series.y[held], "said": said, "count": count})
        return out

    said = _worked(_pieces(asked, packed, folds), work, folds, TOLD_ROWS, seed)
    key = ["symbol", "model", "trial", "fold"]
    rows = said.filter("reason IS NULL").groupBy(*key, "pos").agg(F.max("actual").alias("actual"), (F.sum("said") / F.sum("count")).alias("said"))
    return rows.groupBy(*key).agg((-_error(metric)).alias("score"))


def lasso_nodes(sums: DataFrame, chosen: DataFrame, asked: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The node table of the asked linear models, from moments of the train rows."""
    place = {c: i for i, c in enumerate(columns)}

    def fit(key: tuple, blocks: pa.Table, models: pa.Table) -> pa.Table:
        out, symbol = [NODE_ROWS.empty_table()], key[0].as_py()
        for row in models.to_pylist():
            p, names, total = json.loads(row["params"]), row["names"], None
            if blocks.num_rows:
                total = sum(lasso.unpacked(m.as_py(), [place[c] for c in names]) for m in blocks.column("moments"))
            if total is None or not np.isfinite(total).all():
                why = "no rows to learn from" if total is None else "features and target must be numbers in every row"
                out.append(_table(NODE_ROWS, symbol=symbol, model=row["model"], reason=why))
                continue
            w, b = lasso.descend(total, [p["alpha"]], p["max_iter"], p["tol"] * 1e-5)
            out.append(_table(NODE_ROWS, symbol=symbol, model=row["model"], tree=0, node=np.arange(len(names) + 1), depth=0, feature=[*names, None],
                              value=np.append(w[0], b[0]), rows=int(total[0, 0]), gain=0.0))
        return pa.concat_tables(out)

    models = asked.join(chosen, "symbol").select("symbol", "model", "params", "names")
    return sums.groupBy("symbol").cogroup(models.groupBy("symbol")).applyInArrow(fit, from_arrow_schema(NODE_ROWS))


def lasso_scores(sums: DataFrame, chosen: DataFrame, asked: DataFrame, columns: Sequence[str], folds: int) -> DataFrame:
    """symbol, model, trial, fold, score of linear models from moments by fold block: all folds and sets of a series at once."""
    place = {c: i for i, c in enumerate(columns)}

    def score(key: tuple, blocks: pa.Table, models: pa.Table) -> pa.Table:
        out = [SCORE_ROWS.empty_table()]
        if blocks.num_rows and models.num_rows:
            rows = models.to_pylist()
            at = [place[c] for c in rows[0]["names"]]
            own = {b: lasso.unpacked(m, at) for b, m in zip(*(blocks.column(c).to_pylist() for c in ("block", "moments")))}
            sets = [json.loads(r["params"]) for r in rows]
            for limits in sorted({(p["max_iter"], p["tol"]) for p in sets}):
                some = [i for i, p in enumerate(sets) if (p["max_iter"], p["tol"]) == limits]
                errors = lasso.fold_errors(own, folds, np.array([sets[i]["alpha"] for i in some]), limits[0], limits[1] * 1e-5)
                for i, line in zip(some, errors):
                    known = np.flatnonzero(np.isfinite(line))
                    if len(known):
                        out.append(_table(SCORE_ROWS, symbol=key[0].as_py(), model="lasso", trial=rows[i]["trial"], fold=known, score=-line[known]))
        return pa.concat_tables(out)

    models = asked.join(chosen, "symbol").select("symbol", "trial", "params", "names")
    return sums.groupBy("symbol").cogroup(models.groupBy("symbol")).applyInArrow(score, from_arrow_schema(SCORE_ROWS))


def _nodes_of(own: dict[str, np.ndarray], some: np.ndarray) -> trees.Nodes:
    """A model's rows of the node table, in order of node; children by place."""
    some = some[np.argsort(own["node"][some], kind="stable")]
    number = own["node"][some]
    child = lambda c: np.where(own[c][some] >= 0, np.searchsorted(number, own[c][some]), -1)
    return trees.Nodes(*[child(c) if c in ("low", "high") else own["place" if c == "feature" else c][some] for c in ("tree", *trees.COLUMNS[2:])])


def _prediction(model: str, own: dict[str, np.ndarray], some: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What a model says. own: columns of the node table, `place` for the feature; some: its rows; x: columns x rows."""
    if model == "lasso":
        at, value = own["place"][some], own["value"][some]
        return value[at >= 0] @ x[at[at >= 0]] + value[at < 0].sum()
    said = trees.leaf_values(_nodes_of(own, some), x)
    return said.sum(axis=0) if model == "xgboost" else said.mean(axis=0)


def _columns_of_nodes(table: pa.Table, place: Mapping[str, int]) -> dict[str, np.ndarray]:
    out = {c: pc.fill_null(table.column(c), -1).to_numpy() for c in ("tree", "node", "depth", "threshold", "low", "high", "value", "rows", "gain")}
    feature = table.column("feature").combine_chunks().dictionary_encode()
    at = np.array([*[place.get(f, -1) for f in feature.dictionary.to_pylist()], -1], np.int64)
    return out | {"place": at[pc.fill_null(feature.indices, -1).to_numpy()]}


def _predicted(models: DataFrame, frame: DataFrame, keep: Sequence[str], by_model: Callable) -> DataFrame:
    """Columns keep, model, prediction. models: `symbol` and what by_model(table, place) makes (name, columns of the node table, rows) of, one per model."""
    columns = [f.name for f in frame.schema.fields if f.dataType.typeName() == "double"]
    place = {c: i for i, c in enumerate(columns)}
    rows = frame.select(F.col("symbol").alias("_of"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept"), F.array(*[F.col(f"`{c}`") for c in columns]).alias("_x"))
    schema = T.StructType([rows.schema["_kept"]]).add("model", "string").add("prediction", "double")

    def say(key: tuple, own: pa.Table, table: pa.Table) -> pa.Table:
        out = []
        if own.num_rows and table.num_rows:
            x = own.column("_x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, -1).T
            for name, nodes_, some in by_model(table, place):
                out.append(pa.table({"_kept": own.column("_kept"), "model": pa.array([name] * own.num_rows), "prediction": _prediction(name, nodes_, some, x)}))
        return pa.concat_tables(out) if out else pa.table({"_kept": own.column("_kept").slice(0, 0), "model": pa.array([], pa.string()), "prediction": pa.array([], pa.float64())})

    told = rows.groupBy("_of").cogroup(models.withColumnRenamed("symbol", "_of").groupBy("_of")).applyInArrow(say, schema)
    return told.select("_kept.*", "model", "prediction")


def predict(nodes: DataFrame, frame: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Columns keep, model, prediction: what every model of a row's symbol says. One plan, whatever the number of symbols and models."""
    def by_model(table: pa.Table, place: Mapping[str, int]) -> Iterator[tuple]:
        own, models = _columns_of_nodes(table, place), np.array(table.column("model").to_pylist(), object)
        for name in sorted(set(models.tolist())):
            yield name, own, np.flatnonzero(models == name)

    return _predicted(nodes.select(*T._parse_datatype_string(NODES).names), frame, keep, by_model)


def packed_nodes(parts: Sequence[dict]) -> bytes:
    """A model's rows of the node table in one value."""
    table = pa.concat_tables([_table(NODE_ROWS, **p) for p in parts]).drop_columns(["symbol", "model", "reason"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked_nodes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def nodes_of(fitted: DataFrame) -> DataFrame:
    """The node table of packed models. fitted: symbol, model, fitted."""
    schema = pa.schema([f for f in NODE_ROWS if f.name != "reason"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table = _unpacked_nodes(row["fitted"])
                own = {"symbol": pa.array([row["symbol"]] * len(table)), "model": pa.array([row["model"]] * len(table))}
                yield from pa.table([own[f.name] if f.name in own else table.column(f.name) for f in schema], schema=schema).to_batches()

    nodes = fitted.select("symbol", "model", "fitted").mapInArrow(unpack, from_arrow_schema(schema))
    return nodes.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in ("low", "high")})


def predict_packed(fitted: DataFrame, frame: DataFrame, keep: Sequence[str]) -> DataFrame:
    """As predict, of packed models: a row per model is shuffled instead of one per node."""
    def by_model(table: pa.Table, place: Mapping[str, int]) -> Iterator[tuple]:
        for row in sorted(table.to_pylist(), key=lambda r: r["model"]):
            own = _columns_of_nodes(_unpacked_nodes(row["fitted"]), place)
            yield row["model"], own, np.arange(len(own["node"]))

    return _predicted(fitted.select("symbol", "model", "fitted"), frame, keep, by_model)


def importances(nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """symbol, model, feature, importance: of trees and forests the mean over trees of a feature's share of all gain, of boosted models its mean
    gain of a split, scaled to sum 1. Linear models have none and come with 0."""
    key = ["symbol", "model"]
    grown = nodes.filter(F.col("feature").isNotNull() & (F.col("model") != "lasso"))
    by_tree = grown.groupBy(*key, "tree", "feature").agg(F.sum("gain").alias("gain"), F.count(F.lit(1)).alias("splits"))
    whole = by_tree.groupBy(*key, "tree").agg(F.sum("gain").alias("all"))
    shares = by_tree.join(whole, [*key, "tree"]).groupBy(*key, "feature").agg(
        F.sum(F.try_divide("gain", "all")).alias("share"), F.try_divide(F.sum("gain"), F.sum("splits")).alias("mean_gain"))
    shares = shares.withColumn("raw", F.when(F.col("model") == "xgboost", F.col("mean_gain")).otherwise(F.col("share")))
    total = shares.groupBy(*key).agg(F.sum("raw").alias("total"))
    known = shares.join(total, key).select(*key, "feature", F.try_divide("raw", "total").alias("importance"))
    every = nodes.select(*key).distinct().join(chosen, "symbol").select(*key, F.explode("names").alias("feature"))
    return every.join(known, [*key, "feature"], "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))


@dataclass(frozen=True)
class Tuning:
    """A search over folds before each fit."""

    init_points: int = 5
    iterations: int = 20
    folds: int = 5


@dataclass
class TrainedPanel:
    """Models of a panel. nodes: the node table; chosen: symbol, names; params: symbol, model, params; cv: symbol, model, fold, score;
    failures: symbol, model, step, reason. pooled: models of all symbols together, by type (no nodes then)."""

    chosen: DataFrame
    params: DataFrame
    cv: DataFrame
    failures: DataFrame
    nodes: DataFrame | None = None
    pooled: dict[str, PipelineModel] | None = None

    def predictions(self, frame: DataFrame, keep: Sequence[str] = ("symbol", "date", "split", "target")) -> DataFrame:
        """Long rows: keep, model, prediction."""
        return pooled.predictions(self.pooled, frame, keep) if self.pooled is not None else predict(self.nodes, frame, keep)

    def importances(self) -> DataFrame:
        return importances(self.nodes, self.chosen)

    def fitted(self) -> DataFrame:
        """symbol, model of what was trained; symbol * for pooled models."""
        if self.pooled is not None:
            return self.params.select("symbol", "model")
        return self.nodes.select("symbol", "model").distinct()

    def save(self, path: str) -> None:
        """Tables below path; pooled models as folders."""
        for name in ("chosen", "params", "cv", "failures", *(("nodes",) if self.nodes is not None else ())):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        for model, fitted in (self.pooled or {}).items():
            fitted.write().overwrite().save(f"{path}/pooled/{model}")

    @staticmethod
    def load(spark: SparkSession, path: str, of_types: Sequence[str] | None = None) -> TrainedPanel:
        """of_types: the types of a pooled panel."""
        tables = {n: spark.read.parquet(f"{path}/{n}") for n in ("chosen", "params", "cv", "failures")}
        if of_types is not None:
            return TrainedPanel(**tables, pooled={m: PipelineModel.load(f"{path}/pooled/{m}") for m in of_types})
        return TrainedPanel(**tables, nodes=spark.read.parquet(f"{path}/nodes"))


MODES = ("per_symbol", "pooled")


def asked_models(symbols: DataFrame, specs: Mapping[str, Mapping], trial: int = 0) -> DataFrame:
    """symbol, model, trial, params, share: these parameter sets for every symbol. specs: by model type."""
    made = [create_model(m, p) for m, p in specs.items()]
    sets = F.array(*[F.struct(F.lit(s.model).alias("model"), F.lit(trial).alias("trial"), F.lit(s.json).alias("params"), F.lit(s.share).alias("share")) for s in made])
    return symbols.select("symbol", F.explode(sets).alias("s")).select("symbol", "s.*")


def train_panel(
    prepared: DataFrame, features: Mapping[str, Sequence[str]] | Sequence[str] | DataFrame, model_types: Sequence[str] = MODEL_TYPES,
    params: Mapping[str, Mapping[str, float | None]] | None = None, folds: int = 0, seed: int = SEED, mode: str = "per_symbol", tuning: Tuning | None = None,
) -> TrainedPanel:
    """Train every model type on the train rows of a prepared frame (`split`, `target`, scaled features).

    mode "per_symbol": each symbol gets its own models, whatever other symbols there are, in a number of jobs that doesn't depend on theirs.
    mode "pooled": one model per type on all rows at once by Spark ML, with the relative change of the close as its label, so that price levels do
    not matter. `tuning` searches parameters on train rows before the fit. Wrong parameters, and series that can't be learned from,
    are recorded as failures of their models; other models go on.
    """
    from barline.operators import search

    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}, not {mode}")
    spark, train = prepared.sparkSession, prepared.where(F.col("split") == "train")
    specs, wrong = {}, []
    for kind in model_types:
        try:
            create_model(kind, (params or {}).get(kind))
            specs[kind] = dict((params or {}).get(kind, {}))
        except ValueError as e:
            if kind not in DEFAULT_PARAMS:
                raise
            wrong.append(("*", kind, "fit", str(e)))
    failures = spark.createDataFrame(wrong, FAILED)
    if mode == "pooled":
        return _train_pooled(train, features, specs, folds, seed, tuning, failures)

    chosen = stage(chosen_features(train, features), "chosen")
    columns = sorted({c for r in chosen.select(F.explode("names").alias("c")).distinct().collect() for c in [r.c]})  # names of features
    rows = train.withColumn("role", F.lit(TRAIN))
    n = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    grown = [m for m in specs if m != "lasso"]
    packed = pack(rows, chosen, columns) if grown else None
    sums = {}
    if "lasso" in specs:
        counted = rows.drop("n").join(n, "symbol")
        sums = {f: lasso.staged_moments(counted, columns, f) for f in {folds, tuning.folds if tuning else folds}}
    asked = asked_models(chosen, specs)
    if tuning:
        found = search.tune_by_folds(packed, sums.get(tuning.folds), chosen, columns, list(specs), tuning, seed, specs)
        asked = found.best
        failures = failures.unionByName(found.failures)
    asked = stage(asked, "asked")
    parts, scored = [], []
    if grown:
        trees_asked = asked.filter(F.col("model") != "lasso")
        parts.append(fit_nodes(packed, trees_asked, seed))
        if folds:
            scored.append(scores(packed, trees_asked, folds, seed=seed))
    if "lasso" in specs:
        linear = asked.filter(F.col("model") == "lasso")
        parts.append(lasso_nodes(sums[folds], chosen, linear, columns))
        if folds:
            scored.append(lasso_scores(sums[folds], chosen, linear, columns, folds))
    nodes = None
    for part in parts:
        nodes = part if nodes is None else nodes.unionByName(part)
    nodes = stage(nodes, "nodes")
    reasons = nodes.filter(F.col("reason").isNotNull()).groupBy("symbol", "model").agg(F.min("reason").alias("reason")).select(
        "symbol", "model", F.lit("fit").alias("step"), "reason")
    cv = None
    for part in scored:
        cv = part if cv is None else cv.unionByName(part)
    cv = stage(cv.select("symbol", "model", "fold", "score"), "cv") if cv is not None else spark.createDataFrame([], "symbol string, model string, fold int, score double")
    good = nodes.filter(F.col("reason").isNull()).drop("reason").join(reasons.select("symbol", "model"), ["symbol", "model"], "left_anti")
    return TrainedPanel(chosen, asked.select("symbol", "model", "params"), cv, failures.unionByName(reasons), nodes=good)


def _train_pooled(train, features, specs, folds, seed, tuning, failures) -> TrainedPanel:
    spark = train.sparkSession
    if isinstance(features, DataFrame):
        features = sorted(r.feature for r in features.select("feature").distinct().collect())
    shared = sorted(set().union(*features.values())) if isinstance(features, Mapping) else list(features)
    models, cv, asked = pooled.train(train, shared, specs, folds, seed, tuning)
    chosen = spark.createDataFrame([("*", shared)], "symbol string, names array<string>")
    told = [("*", m, create_model(m, p).json) for m, p in asked.items()]
    return TrainedPanel(
        chosen, spark.createDataFrame(told, "symbol string, model string, params string"),
        spark.createDataFrame(cv, "symbol string, model string, fold int, score double"), failures, pooled=models)
