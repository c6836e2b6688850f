"""Hyper-parameter search: the first sets spread over the box, each later one is proposed from what was scored.

A Gaussian process over the unit box gives the expected improvement of some hundred points; the best of them is next. Proposals are made for every
(symbol, model) at once, from its own trials, a few at a time (AT_ONCE; a proposed point counts with the mean score until it is scored), and
scored by Spark for all of them together. On validation rows, a series that is small enough goes through its whole search inside a task: fits that hold all
sets of the box are made once, and boosted models of many series grow together.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from barline.functions.metrics import EPSILON
from barline.operators import lasso, panel, trees
from barline.operators.models import NESTED, SEARCH_BOUNDS, SEED, VALIDATION_SEARCH_BOUNDS, ModelSpec, create_model
from barline.operators.splits import split_by_ratio
from barline.sources.scratch import stage

Bounds = Mapping[str, tuple[float, float]]
#: Points whose expected improvement is looked at, the process's length in the unit box, and its noise.
LOOKED_AT, LENGTH, NOISE = 512, 0.3, 1e-4
#: Points that are proposed before the next are scored.
AT_ONCE = 4
#: Cells (features x rows) of a series up to which one task searches it whole, cells of the series that it searches together, and how many of these
#: series a task gets at most.
SMALL_SERIES, SEARCHED_TOGETHER, SERIES_OF_TASK = 40_000, 60_000, 32


def _primes(count: int) -> list[int]:
    out: list[int] = []
    n = 2
    while len(out) < count:
        if all(n % p for p in out):
            out.append(n)
        n += 1
    return out


def _digit_mirror(i: int, base: int) -> float:
    out, share = 0.0, 1.0 / base
    while i:
        i, digit = divmod(i, base)
        out += digit * share
        share /= base
    return out


def candidates(bounds: Bounds, count: int, seed: int = SEED) -> list[dict[str, float]]:
    """`count` parameter sets spread evenly over the box (a seeded Halton sequence)."""
    out = []
    for i in range(count):
        point = {}
        for (name, (low, high)), base in zip(bounds.items(), _primes(len(bounds)), strict=True):
            point[name] = low + (high - low) * _digit_mirror(seed + 1 + i, base)
        out.append(point)
    return out


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.exp(-((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2) / (2 * LENGTH**2 * a.shape[1]))


def propose(bounds: Bounds, points: Sequence[Mapping[str, float]], scores: Sequence[float], seed: int = SEED) -> dict[str, float]:
    """The next point of the box. A score that is no number counts as the worst one seen."""
    names = list(bounds)
    low, high = np.array([bounds[n] for n in names], float).T
    at = np.array([[p[n] for n in names] for p in points], float)
    at = (at - low) / np.where(high > low, high - low, 1)
    y = np.array([s if s is not None and math.isfinite(s) else np.nan for s in scores], float)
    draw = np.random.default_rng([seed, len(points)])
    looked = draw.random((LOOKED_AT, len(names)))
    if np.isnan(y).all():
        best = looked[0]
    else:
        y = np.where(np.isnan(y), np.nanmin(y), y)
        # half of what is looked at lies near the best point so far
        near = at[y.argmax()] + draw.normal(scale=0.1, size=(LOOKED_AT // 2, len(names)))
        looked[: LOOKED_AT // 2] = np.clip(near, 0, 1)
        # ranks, so that one terrible score doesn't flatten all others
        z = np.argsort(np.argsort(y, kind="stable"), kind="stable") / max(len(y) - 1, 1) * 0.5 + 0.5 * (y - y.min()) / max(np.ptp(y), 1e-300)
        z = (z - z.mean()) / max(z.std(), 1e-9)
        inverse = np.linalg.inv(_kernel(at, at) + NOISE * np.eye(len(at)))
        cross = _kernel(looked, at)
        mean = cross @ inverse @ z
        spread = np.sqrt(np.maximum(1 - np.einsum("ij,jk,ik->i", cross, inverse, cross), 1e-12))
        ahead = (mean - z.max() - 0.01) / spread
        density = np.exp(-(ahead**2) / 2) / math.sqrt(2 * math.pi)
        below = 0.5 * (1 + np.vectorize(math.erf)(ahead / math.sqrt(2)))
        best = looked[(spread * (ahead * below + density)).argmax()]
    return {n: float(v) for n, v in zip(names, low + (high - low) * best)}


def tune_one(
    score: Callable[[dict], float], model_type: str, init_points: int, iterations: int, seed: int = SEED, fixed: Mapping | None = None, bounds: Bounds | None = None,
) -> dict[str, float]:
    """The best set of one search whose trials are scored by a function, one after another."""
    bounds = bounds or SEARCH_BOUNDS[model_type]
    points = candidates(bounds, init_points, seed)
    scores = [score({**(fixed or {}), **p}) for p in points]
    for _ in range(iterations):
        points.append(propose(bounds, points, scores, seed))
        scores.append(score({**(fixed or {}), **points[-1]}))
    return {**(fixed or {}), **points[int(np.argmax(np.nan_to_num(scores, nan=-np.inf)))]}


@dataclass
class SearchResult:
    """trials: symbol, model, trial, point (where in the box), params, share, score. best: symbol, model, trial, params, share. failures: symbol,
    model, step, reason."""

    trials: DataFrame
    best: DataFrame
    failures: DataFrame


ASKED = "symbol string, model string, trial int, point string, params string, share string"


def _first(symbols: DataFrame, boxes: Mapping[str, Bounds], fixed: Mapping[str, Mapping], init_points: int, seed: int) -> DataFrame:
    sets = []
    for kind, bounds in boxes.items():
        for i, point in enumerate(candidates(bounds, init_points, seed)):
            spec = create_model(kind, {**fixed.get(kind, {}), **point})
            sets.append(F.struct(F.lit(kind).alias("model"), F.lit(i).alias("trial"), F.lit(json.dumps(point)).alias("point"), F.lit(spec.json).alias("params"),
                                 F.lit(spec.share).alias("share")))
    return symbols.select("symbol", F.explode(F.array(*sets)).alias("s")).select("symbol", "s.*")


def propose_some(bounds: Bounds, points: Sequence[Mapping[str, float]], scores: Sequence[float], count: int, seed: int = SEED) -> list[dict[str, float]]:
    points, scores = list(points), list(scores)
    known = [s for s in scores if s is not None and math.isfinite(s)]
    out = []
    for _ in range(count):
        out.append(propose(bounds, points, scores, seed))
        points.append(out[-1])
        scores.append(sum(known) / len(known) if known else None)
    return out


def _next(trials: DataFrame, boxes: Mapping[str, Bounds], fixed: Mapping[str, Mapping], count: int, seed: int) -> DataFrame:
    def ahead(key: tuple, own: pa.Table) -> pa.Table:
        symbol, kind = (k.as_py() for k in key)
        own = own.sort_by("trial")
        points = propose_some(boxes[kind], [json.loads(p) for p in own.column("point").to_pylist()], own.column("score").to_pylist(), count, seed)
        specs = [create_model(kind, {**fixed.get(kind, {}), **p}) for p in points]
        return pa.table({
            "symbol": [symbol] * count, "model": [kind] * count, "trial": pa.array(range(own.num_rows, own.num_rows + count), pa.int32()),
            "point": [json.dumps(p) for p in points], "params": [s.json for s in specs], "share": [s.share for s in specs]})

    return trials.groupBy("symbol", "model").applyInArrow(ahead, ASKED)


def run_search(
    symbols: DataFrame, boxes: Mapping[str, Bounds], score: Callable[[DataFrame], DataFrame], init_points: int, iterations: int, seed: int = SEED,
    fixed: Mapping[str, Mapping] | None = None,
) -> SearchResult:
    """score: asked sets to symbol, model, trial, score. All symbols and models go through a trial together."""
    fixed = fixed or {}

    def scored(asked: DataFrame) -> DataFrame:
        asked = stage(asked, "asked")
        return asked.join(score(asked), ["symbol", "model", "trial"], "left")

    trials = stage(scored(_first(symbols, boxes, fixed, init_points, seed)), "trials")
    for done in range(0, iterations, AT_ONCE):
        count = min(AT_ONCE, iterations - done)
        trials = stage(trials.unionByName(scored(_next(trials, boxes, fixed, count, seed))), "trials")
    return _result(trials)


def _result(trials: DataFrame) -> SearchResult:
    known = trials.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    pick = F.max_by(F.struct("trial", "params", "share"), F.struct("score", -F.col("trial")))
    best = known.groupBy("symbol", "model").agg(pick.alias("b")).select("symbol", "model", "b.*")
    none = trials.select("symbol", "model").distinct().join(known, ["symbol", "model"], "left_anti").select(
        "symbol", "model", F.lit("search").alias("step"), F.lit("no trial could be scored").alias("reason"))
    return SearchResult(trials, best, none)


def _mean(scores: DataFrame) -> DataFrame:
    return scores.groupBy("symbol", "model", "trial").agg(F.avg("score").alias("score"))


def tune_by_folds(
    packed: DataFrame | None, sums: DataFrame | None, chosen: DataFrame, columns: Sequence[str], model_types: Sequence[str], tuning: panel.Tuning = panel.Tuning(),
    seed: int = SEED, fixed: Mapping[str, Mapping] | None = None,
) -> SearchResult:
    """Maximise the mean negative squared error over expanding-window folds of the train rows."""
    def score(asked: DataFrame) -> DataFrame:
        parts = []
        if any(m != "lasso" for m in model_types):
            parts.append(_mean(panel.scores(packed, asked.filter(F.col("model") != "lasso"), tuning.folds, seed=seed)))
        if "lasso" in model_types:
            parts.append(_mean(panel.lasso_scores(sums, chosen, asked.filter(F.col("model") == "lasso"), columns, tuning.folds)))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    boxes = {m: SEARCH_BOUNDS[m] for m in model_types}
    return run_search(chosen, boxes, score, tuning.init_points, tuning.iterations, seed, fixed)


@dataclass
class TunedModels:
    search: SearchResult
    nodes: DataFrame
    predictions: DataFrame


def by_validation(supervised: DataFrame, features: Sequence[str], ratios: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The frame with its ratio split, packed train and validation rows, and the features of each symbol."""
    frame = stage(split_by_ratio(supervised, ratios), "split")
    rows = frame.filter(F.col("split") != "test").withColumn("role", F.when(F.col("split") == "train", panel.TRAIN).otherwise(panel.OTHER))
    chosen = stage(panel.chosen_features(frame, features), "chosen")
    return frame, panel.pack(rows, chosen, features), chosen


def validation_scores(packed: DataFrame, asked: DataFrame, seed: int = SEED) -> DataFrame:
    """symbol, model, trial, score: negative percentage error on the validation rows of models fitted on the train rows."""
    return _mean(panel.scores(packed, asked, 0, "mape", seed))


def tune_on_validation(
    supervised: DataFrame, features: Sequence[str], model_types: Sequence[str], ratios: dict[str, float] | None = None, init_points: int = 5,
    iterations: int = 5, bounds: Mapping[str, Bounds] | None = None, seed: int = SEED,
) -> TunedModels:
    """Minimise the percentage error on the validation part of a ratio split, refit on train with the best set.

    `predictions` holds symbol, date, pos, split, cut positions, close, target, model and prediction of every row.
    """
    frame, packed, chosen = by_validation(supervised, features, ratios)
    boxes = {m: (bounds or VALIDATION_SEARCH_BOUNDS)[m] for m in model_types}
    keep = [c for c in frame.columns if c not in ("model", "prediction")]
    large = F.col("n") * F.size("names") > SMALL_SERIES
    few = packed.where(large).select("symbol")
    searched = search_inside_tasks(chosen.join(few, "symbol", "left_anti"), packed.where(~large), boxes, init_points, iterations, seed)
    fitted = searched.where(F.col("fitted").isNotNull())
    trials, nodes, said = searched.drop("fitted"), panel.nodes_of(fitted), panel.predict_packed(fitted, frame, keep)
    if few.isEmpty():
        return TunedModels(_result(trials), nodes, said)
    packed, chosen = packed.where(large), chosen.join(few, "symbol", "left_semi")
    found = run_search(chosen, boxes, lambda asked: validation_scores(packed, asked, seed), init_points, iterations, seed)
    own = stage(panel.fit_nodes(packed, stage(found.best, "best"), seed), "nodes")
    own = own.filter(F.col("reason").isNull()).drop("reason")
    return TunedModels(_result(trials.unionByName(found.trials)), nodes.unionByName(own), said.unionByName(panel.predict(own, frame, keep)))


SEARCHED_ROWS = pa.schema([
    ("symbol", pa.string()), ("model", pa.string()), ("trial", pa.int32()), ("point", pa.string()), ("params", pa.string()), ("share", pa.string()),
    ("score", pa.float64()), ("fitted", pa.binary())])


def search_inside_tasks(
    chosen: DataFrame, packed: DataFrame, boxes: Mapping[str, Bounds], init_points: int, iterations: int, seed: int = SEED,
) -> DataFrame:
    """symbol, model, trial, point, params, share, score and, of the best trial, fitted (see panel.packed_nodes). What run_search finds with
    validation_scores, with the same proposals; a task goes through the whole search of its series. Series without packed rows get trials without a score."""
    rows = stage(chosen.select("symbol").join(packed, "symbol", "left"), "small-series")
    number = rows.count()
    parts = max(min(number, rows.sparkSession.sparkContext.defaultParallelism), -(-number // SERIES_OF_TASK), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, cells = [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                waiting.append(Searched(batch.slice(at, 1).to_pylist()[0], boxes))
                cells += waiting[-1].cells
                if cells >= SEARCHED_TOGETHER:
                    yield from _search_together(waiting, boxes, init_points, iterations, seed)
                    waiting, cells = [], 0
        if waiting:
            yield from _search_together(waiting, boxes, init_points, iterations, seed)

    return stage(rows.repartition(parts).mapInArrow(run, from_arrow_schema(SEARCHED_ROWS)), "searched")


class Searched:
    """A series on its way through a search inside a task: trials and scores by type, and the fits that tell them."""

    def __init__(self, row: Mapping, boxes: Mapping[str, Bounds]):
        self.symbol, self.names, self.cells, self.usable = row["symbol"], row["names"], 0, False
        self.points: dict[str, list[dict]] = {kind: [] for kind in boxes}
        self.specs: dict[str, list[ModelSpec]] = {kind: [] for kind in boxes}
        self.scores: dict[str, list[float | None]] = {kind: [] for kind in boxes}
        self.fits: dict[tuple[str, str], tuple[dict, list[trees.Nodes]]] = {}  # by type and share: the widest set, and its trees by part
        self.lines: dict[str, tuple[np.ndarray, float]] = {}
        if row["x"] is None:
            return
        series = panel.Series.read(row)
        learn, held = series.train(-1, 0), series.test(-1, 0)
        self.cells = series.x.size
        self.usable = bool(np.isfinite(series.x).all() and np.isfinite(series.y).all() and learn.any() and held.any())
        if self.usable:
            self.x, self.y, self.there, self.actual = series.x[:, learn], series.y[learn], series.x[:, held], series.y[held]
            self.sums = panel.moments_of(self.x, self.y)

    def told(self, kind: str, spec: ModelSpec, said: np.ndarray) -> float:
        return -float(np.mean(np.abs(self.actual - said) / np.maximum(np.abs(self.actual), EPSILON)))


def _widest(kind: str, spec: ModelSpec, bounds: Bounds) -> dict:
    """A set of this share that holds every other one of the box."""
    out = dict(spec.params)
    for name in NESTED[kind]:
        if name in bounds:
            low, high = (int(v) for v in bounds[name])
            out[name] = low if name == "min_samples_split" else None if name == "max_depth" and low <= 1 else high
    return out


def _score_some(some: list[Searched], first: int, boxes: Mapping[str, Bounds], seed: int) -> None:
    """Score the trials from number `first` on."""
    usable = [s for s in some if s.usable]
    if "xgboost" in boxes:  # grown as far as a set asks for: rounds are most of the work
        asked: dict[tuple[int, str], dict] = {}
        for i, s in enumerate(usable):
            for spec in s.specs["xgboost"][first:]:
                most = max([asked.get((i, spec.share)), s.fits.get(("xgboost", spec.share), (None,))[0]], key=lambda p: p["n_estimators"] if p else 0)
                if not most or most["n_estimators"] < spec.params["n_estimators"]:
                    asked[i, spec.share] = dict(spec.params)
        grown = trees.boosted_together([(usable[i].x, usable[i].y, p) for (i, _), p in asked.items()], seed)
        for ((i, share), p), nodes in zip(asked.items(), grown):
            usable[i].fits["xgboost", share] = p, [nodes]
    if "lasso" in boxes:
        lines = [(s, spec) for s in usable for spec in s.specs["lasso"][first:]]
        solved = lasso.descend_together([(s.sums, spec.params["alpha"], spec.params["max_iter"], spec.params["tol"] * 1e-5) for s, spec in lines])
        for (s, spec), line in zip(lines, solved):
            s.lines[spec.json] = line
    for s in some:
        for kind, specs in s.specs.items():
            s.scores[kind] += _scores_of(s, kind, specs[first:], boxes[kind], seed) if s.usable else [None] * len(specs[first:])


def _scores_of(s: Searched, kind: str, specs: Sequence[ModelSpec], bounds: Bounds, seed: int) -> list[float | None]:
    out: dict[int, float] = {}
    by_share: dict[str, list[int]] = {}
    for k, spec in enumerate(specs):
        by_share.setdefault(spec.share, []).append(k)
    for share, own in by_share.items():
        sets = [dict(specs[k].params) for k in own]
        if kind == "lasso":
            told = [(w @ s.there + b, 1) for w, b in (s.lines[specs[k].json] for k in own)]
        else:
            if (kind, share) not in s.fits:
                widest = _widest(kind, specs[own[0]], bounds)
                parts = -(-widest["n_estimators"] // panel.TREES_OF_PART) if kind == "random_forest" else 1
                s.fits[kind, share] = widest, [panel.fit_trees(kind, s.x, s.y, [widest], part, seed) for part in range(parts)]
            by_part = [panel.said_by(kind, nodes, s.there, sets) for nodes in s.fits[kind, share][1]]
            told = [(sum(said for said, _ in parts), sum(n for _, n in parts)) for parts in zip(*by_part)]
        for k, (said, count) in zip(own, told):
            out[k] = s.told(kind, specs[k], said / count)
    return [out[k] for k in range(len(specs))]


def _packed_best(s: Searched, kind: str, spec: ModelSpec) -> bytes:
    if kind == "lasso":
        w, b = s.lines[spec.json]
        return panel.packed_nodes([panel.lasso_columns(s.names, w, b, len(s.y))])
    p, out = spec.params, []
    for part, nodes in enumerate(s.fits[kind, spec.share][1]):
        if kind == "xgboost":
            own = trees.stopped(nodes, None, 0, p["n_estimators"] + 1)  # tree 0 says the mean
        else:
            own = trees.stopped(nodes, p["max_depth"], p["min_samples_split"], p["n_estimators"] if kind == "random_forest" else 1)
        if len(own.tree):
            out.append(panel.node_columns(s.names, own, part))
    return panel.packed_nodes(out)


def _search_together(some: list[Searched], boxes: Mapping[str, Bounds], init_points: int, iterations: int, seed: int) -> Iterator[pa.RecordBatch]:
    first = {kind: candidates(bounds, init_points, seed) for kind, bounds in boxes.items()}
    for done in range(-AT_ONCE, iterations, AT_ONCE):
        at = 0 if done < 0 else init_points + done
        for s in some:
            for kind, bounds in boxes.items():
                more = first[kind] if done < 0 else propose_some(bounds, s.points[kind], s.scores[kind], min(AT_ONCE, iterations - done), seed)
                s.points[kind] += more
                s.specs[kind] += [create_model(kind, p) for p in more]
        _score_some(some, at, boxes, seed)
    for s in some:
        for kind in boxes:
            known = [k for k, v in enumerate(s.scores[kind]) if v is not None and not math.isnan(v)]
            best = max(known, key=lambda k: (s.scores[kind][k], -k), default=None)
            specs = s.specs[kind]
            yield from pa.table({
                "symbol": [s.symbol] * len(specs), "model": [kind] * len(specs), "trial": range(len(specs)), "point": [json.dumps(p) for p in s.points[kind]],
                "params": [spec.json for spec in specs], "share": [spec.share for spec in specs], "score": s.scores[kind],
                "fitted": [_packed_best(s, kind, specs[k]) if k == best else None for k in range(len(specs))]}, schema=SEARCHED_ROWS).to_batches()
