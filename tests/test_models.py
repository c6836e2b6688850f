"""Trees, linear models, searches and whole trainings on small panels."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.operators import evaluate, forecast, lasso, models, panel, search, trees
from barline.operators.features import supervised_frame
from barline.plans import pipeline

NAMES = ["a", "b", "c"]
SMALL = {"random_forest": {"n_estimators": 30, "max_depth": 4}, "xgboost": {"n_estimators": 20, "max_depth": 3}, "lasso": {"alpha": 0.01}}


def some_rows(symbol: str, seed: int, n: int = 240) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame(rng.normal(size=(n, 3)), columns=NAMES)
    frame["target"] = 3 * frame.a - 2 * frame.b + rng.normal(scale=0.1, size=n)
    frame["symbol"], frame["close"] = symbol, 1.0
    frame["date"] = pd.date_range("2020-01-01", periods=n).date
    frame["pos"], frame["n"] = np.arange(1, n + 1), n
    frame["split"] = np.where(frame.pos <= n * 2 // 3, "train", np.where(frame.pos <= n * 5 // 6, "val", "test"))
    return frame


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(some_rows("A", 1)).cache()


@pytest.fixture(scope="module")
def trained(rows):
    return panel.train_panel(rows, NAMES, params=SMALL, folds=2)


# trees

def tree_by_hand(x, y, depth, min_split, min_leaf, idx=None, d=0):
    idx = np.arange(len(y)) if idx is None else idx
    node = {"value": y[idx].mean()}
    if d == depth or len(idx) < min_split or y[idx].max() == y[idx].min():
        return node
    best = None
    for f in range(len(x)):
        o = idx[np.argsort(x[f, idx], kind="stable")]
        sums, m = np.cumsum(y[o]), len(o)
        for i in range(min_leaf - 1, m - min_leaf):
            if x[f, o[i + 1]] - x[f, o[i]] > 1e-7:
                gain = sums[i] ** 2 / (i + 1) + (sums[-1] - sums[i]) ** 2 / (m - i - 1)
                if best is None or gain > best[0] + 1e-9:
                    best = gain, f, (x[f, o[i]] + x[f, o[i + 1]]) / 2
    if best is None:
        return node
    _, f, cut = best
    low = x[f, idx] <= cut
    return node | {"f": f, "cut": cut, "low": tree_by_hand(x, y, depth, min_split, min_leaf, idx[low], d + 1),
                   "high": tree_by_hand(x, y, depth, min_split, min_leaf, idx[~low], d + 1)}


def walk(node, row):
    while "f" in node:
        node = node["low"] if row[node["f"]] <= node["cut"] else node["high"]
    return node["value"]


@pytest.mark.parametrize("depth,min_split,min_leaf", [(6, 5, 2), (None, 2, 1), (3, 30, 10), (20, 2, 7)])
def test_tree_equals_one_grown_by_hand(depth, min_split, min_leaf):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(4, 150)), rng.normal(size=150)
    x[3] = np.round(x[3])  # equal values
    grown = trees.decision_tree(x, y, depth, min_split, min_leaf)
    hand = tree_by_hand(x, y, depth, min_split, min_leaf)
    there = rng.normal(size=(4, 60))
    for at in (x, there):
        assert trees.leaf_values(grown, at)[0] == pytest.approx([walk(hand, at[:, i]) for i in range(at.shape[1])])
    leaves = grown.feature < 0
    assert grown.rows[leaves].min() >= min_leaf and grown.rows[leaves].sum() == 150
    assert grown.rows[~leaves].min() >= min_split


def test_larger_fits_hold_smaller_ones():
    """Stopping at a depth, at nodes of few rows or after some trees gives what a fit with these limits gives."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(5, 300)), rng.normal(size=300)
    there = rng.normal(size=(5, 80))
    deep = trees.forest(x, y, range(12), None, 2, 3)
    for depth, split, count in ((4, 2, 12), (20, 15, 12), (3, 9, 5)):
        own = trees.forest(x, y, range(count), depth, split, 3)
        assert trees.leaf_values(deep, there, depth, split)[:count] == pytest.approx(trees.leaf_values(own, there))
    long = trees.boosted(x, y, 30, 4, 0.1, 0.8, 0.6)
    assert trees.leaf_values(long, there)[:11] == pytest.approx(trees.leaf_values(trees.boosted(x, y, 10, 4, 0.1, 0.8, 0.6), there))
    # a forest's trees don't depend on what they are grown with
    parts = [trees.forest(x, y, range(a, a + 4), 6, 2, 1) for a in (0, 4, 8)]
    assert trees.leaf_values(trees.Nodes.joined(parts), there) == pytest.approx(trees.leaf_values(trees.forest(x, y, range(12), 6, 2, 1), there))


def test_boosting_of_one_round_by_hand():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(1, 40)), rng.normal(size=40)
    made = trees.boosted(x, y, 1, 1, 0.5)
    order = np.argsort(x[0])
    r = (y - y.mean())[order]
    best = max(range(39), key=lambda i: r[:i + 1].sum() ** 2 / (i + 2) + r[i + 1:].sum() ** 2 / (40 - i))
    low, high = r[:best + 1].sum() / (best + 2) * 0.5, r[best + 1:].sum() / (40 - best) * 0.5
    expected = y.mean() + np.where(np.arange(40) <= best, low, high)
    assert trees.leaf_values(made, x).sum(axis=0)[order] == pytest.approx(expected)


def test_boosted_models_grown_together_are_what_they_are_alone():
    """Models of other series, rows, scales and parameters share numpy calls, and nothing else: every bit is the same."""
    rng, asked = np.random.default_rng(5), []
    for i in range(12):
        x, n = rng.normal(size=(3, 20 + 15 * i)), 20 + 15 * i
        own = {"n_estimators": 1 + 2 * (i % 4), "max_depth": (None, 2, 6)[i % 3], "learning_rate": 0.1 + i / 100, "subsample": (1.0, 0.7)[i % 2],
               "colsample_bytree": (1.0, 0.8)[i % 2]}
        asked.append((x, (x[0] - x[1]) * 10.0 ** (i - 4), own))
    for (x, y, own), nodes in zip(asked, trees.boosted_together(asked, 7)):
        alone = trees.boosted_together([(x, y, own)], 7)[0]
        assert nodes.tree.max() == own["n_estimators"]
        for c in ("tree", *trees.COLUMNS[2:]):
            np.testing.assert_array_equal(getattr(nodes, c), getattr(alone, c))


def test_constant_features_and_targets():
    x = np.ones((2, 10))
    assert len(trees.decision_tree(x, np.arange(10.0)).tree) == 1
    assert len(trees.decision_tree(np.arange(20.0).reshape(2, 10), np.ones(10)).tree) == 1
    assert trees.leaf_values(trees.forest(x, np.arange(10.0), range(3)), x).shape == (3, 10)


# lasso

def coordinate_descent(x, y, alpha, sweeps=2000):
    xc, yc, w = x - x.mean(0), y - y.mean(), np.zeros(x.shape[1])
    for _ in range(sweeps):
        for j in range(x.shape[1]):
            rest = xc[:, j] @ (yc - xc @ w + xc[:, j] * w[j]) / len(y)
            w[j] = np.sign(rest) * max(abs(rest) - alpha, 0) / (xc[:, j] @ xc[:, j] / len(y))
    return w, y.mean() - x.mean(0) @ w


def test_lasso_from_moments_equals_spark_ml_and_descent(rows):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    frame = rows.toPandas()
    x, y = frame[NAMES].to_numpy(), frame.target.to_numpy()
    sums = lasso.moments(rows, NAMES, F.lit(0)).collect()
    assert len(sums) == 1
    alphas = [0.01, 0.5, 5.0]
    w, b = lasso.descend(lasso.unpacked(sums[0].moments), alphas)
    ml = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows)
    for i, alpha in enumerate(alphas):
        expected, intercept = coordinate_descent(x, y, alpha)
        assert w[i] == pytest.approx(expected, abs=1e-8) and b[i] == pytest.approx(intercept, abs=1e-8)
        spark_ml = LinearRegression(labelCol="target", regParam=alpha, elasticNetParam=1.0, standardization=False, tol=1e-12, maxIter=5000).fit(ml)
        assert w[i] == pytest.approx(spark_ml.coefficients.toArray(), abs=1e-6)
    errors = lasso.squared_errors(lasso.unpacked(sums[0].moments), w, b)
    assert errors == pytest.approx([((y - x @ w[i] - b[i]) ** 2).mean() for i in range(3)])


def test_folds_from_moments(spark, rows):
    """Scores on expanding folds are those of fits on the rows themselves."""
    sums = lasso.staged_moments(rows, NAMES, 4)
    chosen = spark.createDataFrame([("A", ["c", "a"])], "symbol string, names array<string>")
    asked = panel.asked_models(chosen, {"lasso": {"alpha": 0.1}})
    got = {r.fold: r.score for r in panel.lasso_scores(sums, chosen, asked, NAMES, 4).collect()}
    frame = rows.orderBy("pos").toPandas()
    x, y = frame[["c", "a"]].to_numpy(), frame.target.to_numpy()
    size = 240 // 5
    for i in range(4):
        start = 240 - (4 - i) * size
        w, b = coordinate_descent(x[:start], y[:start], 0.1)
        assert got[i] == pytest.approx(-((y - x @ w - b)[start:start + size] ** 2).mean(), rel=1e-6)
    packed = panel.pack(rows.withColumn("role", F.lit(0)), chosen, NAMES)
    same = {r.fold: r.score for r in panel.scores(packed, asked, 4).collect()}
    assert same == pytest.approx(got, rel=1e-6)


# parameters

def test_factory_and_defaults():
    assert models.whole({"max_depth": 1.0, "n_estimators": 7.9}) == {"max_depth": None, "n_estimators": 7}
    tree = models.create_model("decision_tree")
    assert tree.params == {"max_depth": 10, "min_samples_split": 5, "min_samples_leaf": 2}
    assert models.create_model("random_forest", {"min_samples_split": 7.5}).params["min_samples_split"] == 7
    assert models.create_model("lasso", models.REQUEST_DEFAULTS["lasso"]).params == {"alpha": 1.0, "max_iter": 1000, "tol": 0.0001}
    for wrong in (("other", {}), ("decision_tree", {"depth": 3}), ("lasso", {"alpha": -1.0}), ("decision_tree", {"min_samples_split": 1})):
        with pytest.raises(ValueError):
            models.create_model(*wrong)


def test_sets_of_one_share():
    share = lambda kind, **p: models.create_model(kind, p).share
    assert share("random_forest", max_depth=3, n_estimators=50) == share("random_forest", max_depth=9, min_samples_split=12)
    assert share("random_forest", min_samples_leaf=1) != share("random_forest", min_samples_leaf=2)
    assert share("xgboost", n_estimators=10) == share("xgboost") != share("xgboost", max_depth=3)


# panels

def test_train_all_types_beats_the_mean(spark, rows, trained, tmp_path):
    assert trained.failures.isEmpty() and trained.fitted().count() == 4 and trained.cv.count() == 8
    said = trained.predictions(rows)
    metrics = evaluate.training_metrics(said)
    r2 = {r.model: r.value for r in metrics.where("metric = 'r2' AND split = 'train'").collect()}
    assert min(r2.values()) > 0.3 and r2["lasso"] > 0.99
    table = evaluate.compare_models(metrics, trained.cv)
    assert table.first().model == "lasso" and table.first().cv_score_mean < 0
    importance = trained.importances().toPandas()
    totals = importance.groupby("model").importance.sum()
    assert totals.drop("lasso").tolist() == pytest.approx([1, 1, 1]) and totals["lasso"] == 0
    assert importance[importance.model == "decision_tree"].sort_values("importance").feature.iloc[-1] == "a"
    trained.save(str(tmp_path / "models"))
    again = panel.TrainedPanel.load(spark, str(tmp_path / "models")).predictions(rows).withColumnRenamed("prediction", "again")
    assert said.join(again, ["symbol", "date", "model"]).filter("prediction <> again").count() == 0


def test_predictions_from_the_table_equal_the_fit(rows, trained):
    """Every type, every split, row by row."""
    frame = rows.orderBy("pos").toPandas()
    x, y = frame[NAMES].to_numpy().T, frame.target.to_numpy()
    learn = (frame.split == "train").to_numpy()
    forest = trees.forest(x[:, learn], y[learn], range(30), 4, 5, 2)
    w, b = coordinate_descent(x[:, learn].T, y[learn], 0.01)
    expected = {
        "decision_tree": trees.leaf_values(trees.decision_tree(x[:, learn], y[learn], 10, 5, 2), x)[0],
        "random_forest": trees.leaf_values(forest, x).mean(axis=0),
        "xgboost": trees.leaf_values(trees.boosted(x[:, learn], y[learn], 20, 3, 0.1, 0.8, 0.8), x).sum(axis=0), "lasso": w @ x + b}
    got = trained.predictions(rows, keep=("date",)).toPandas()
    for kind, own in got.groupby("model"):
        assert own.sort_values("date").prediction.to_numpy() == pytest.approx(expected[kind], abs=1e-6)


def test_tree_scores_on_folds(rows, trained):
    frame = rows.orderBy("pos").filter("split = 'train'").toPandas()
    x, y, n = frame[NAMES].to_numpy().T, frame.target.to_numpy(), len(frame)
    got = {(r.model, r.fold): r.score for r in trained.cv.collect()}
    for fold in range(2):
        start, size = n - (2 - fold) * (n // 3), n // 3
        test = slice(start, start + size)
        tree = trees.decision_tree(x[:, :start], y[:start], 10, 5, 2)
        assert got["decision_tree", fold] == pytest.approx(-((trees.leaf_values(tree, x[:, test])[0] - y[test]) ** 2).mean())
        forest = trees.forest(x[:, :start], y[:start], range(30), 4, 5, 2)  # two parts
        assert got["random_forest", fold] == pytest.approx(-((trees.leaf_values(forest, x[:, test]).mean(axis=0) - y[test]) ** 2).mean())


def test_a_symbol_does_not_depend_on_others_and_jobs_do_not_grow(spark, rows):
    """The models of a symbol are the same whether it is alone or beside others, and as many jobs train them."""
    def jobs(frame):
        group = f"jobs-{frame.rdd.id()}"
        spark.sparkContext.setJobGroup(group, group)
        made = panel.train_panel(frame, NAMES, ["decision_tree", "lasso"], {"lasso": {"alpha": 0.01}}, folds=2)
        spark.sparkContext.setJobGroup("other", "other")
        return made, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    many = spark.createDataFrame(pd.concat([some_rows("A", 1), *[some_rows(f"S{i}", i + 10, 120) for i in range(30)]]))
    alone, few = jobs(rows)
    beside, more = jobs(many)
    assert beside.fitted().count() == 62 and more <= few + 3
    key = ["model", "tree", "node"]
    one = alone.nodes.select(*key, "feature", F.round("value", 9).alias("v"))
    assert one.exceptAll(beside.nodes.filter("symbol = 'A'").select(*one.columns[:-1], F.round("value", 9).alias("v"))).isEmpty()
    assert alone.cv.collect()[0].score in [r.score for r in beside.cv.filter("symbol = 'A'").collect()]


def test_failures_are_recorded(spark, rows):
    wrong = panel.train_panel(rows, NAMES, ["lasso", "decision_tree"], {"lasso": {"alpha": -1.0}})
    assert [(r.model, r.step) for r in wrong.failures.collect()] == [("lasso", "fit")] and [r.model for r in wrong.fitted().collect()] == ["decision_tree"]
    gaps = rows.unionByName(spark.createDataFrame(some_rows("B", 2)).withColumn("a", F.when(F.col("pos") > 5, F.col("a"))))
    made = panel.train_panel(gaps, NAMES, ["lasso", "decision_tree"], SMALL)
    assert {(r.symbol, r.model) for r in made.failures.collect()} == {("B", "lasso"), ("B", "decision_tree")}
    assert {(r.symbol, r.model) for r in made.fitted().collect()} == {("A", "lasso"), ("A", "decision_tree")}
    with pytest.raises(ValueError):
        panel.train_panel(rows, NAMES, ["other"])
    with pytest.raises(ValueError):
        panel.train_panel(rows, NAMES, mode="many")


def test_pooled_mode_trains_one_model_per_type(spark, make_bars, tmp_path):
    rng = np.random.default_rng(2)
    bars = make_bars({s: list(50 + rng.normal(size=220).cumsum().round(2)) for s in "AB"})
    prepared = pipeline.preprocess(bars, pipeline.PipelineConfig(feature_window=1))
    made = panel.train_panel(prepared.frame, prepared.features_of_any(), ["decision_tree"], {"decision_tree": {"max_depth": 3}}, folds=2, mode="pooled")
    assert list(made.pooled) == ["decision_tree"] and made.cv.count() == 2 and made.failures.isEmpty()
    assert [(r.symbol, r.model) for r in made.fitted().collect()] == [("*", "decision_tree")]
    said = made.predictions(prepared.frame)
    assert said.agg(F.max(F.abs(F.col("prediction") / F.col("target") - 1))).first()[0] < 1
    made.save(str(tmp_path / "pooled"))
    again = panel.TrainedPanel.load(spark, str(tmp_path / "pooled"), ["decision_tree"]).predictions(prepared.frame)
    assert again.agg(F.sum("prediction")).first()[0] == pytest.approx(said.agg(F.sum("prediction")).first()[0])


# searches

def test_pooled_rows_are_dealt_evenly(spark, rows):
    """Parts of the train table hold as many rows, however uneven the parts are that they come from; a fit reads them once written."""
    from barline.operators import pooled

    uneven = rows.coalesce(1)
    dealt = pooled.dealt(uneven, NAMES)
    sizes = [r["count"] for r in dealt.groupBy(F.col("_metadata.file_path")).count().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 2 * min(sizes) and sum(sizes) == rows.count()
    assert set(dealt.columns) == {"symbol", "date", "pos", "n", "target", *NAMES}


def test_candidates_fill_the_box():
    points = search.candidates(models.SEARCH_BOUNDS["random_forest"], 50)
    assert points == search.candidates(models.SEARCH_BOUNDS["random_forest"], 50)
    for name, (low, high) in models.SEARCH_BOUNDS["random_forest"].items():
        values = [p[name] for p in points]
        assert low <= min(values) and max(values) <= high and max(values) - min(values) > 0.8 * (high - low)


def test_proposals_beat_the_fixed_sequence():
    """Of 25 trials on a known surface, those that learn find a better point than those spread out, for most of ten seeds and on average."""
    box = {"x": (0.0, 10.0), "y": (-5.0, 5.0), "z": (0.0, 1.0)}
    surface = lambda p: -((p["x"] - 7.3) ** 2 + 2 * (p["y"] - 1.1) ** 2 + 9 * (p["z"] - 0.2) ** 2)
    learned, spread = [], []
    for seed in range(10):
        points = search.candidates(box, 5, seed)
        scores = [surface(p) for p in points]
        for _ in range(5):
            more = search.propose_some(box, points, scores, 4, seed)
            points += more
            scores += [surface(p) for p in more]
        assert len(points) == 25 and all(low <= p[n] <= high for p in points for n, (low, high) in box.items())
        learned.append(max(scores))
        spread.append(max(surface(p) for p in search.candidates(box, 25, seed)))
    assert sum(a > b for a, b in zip(learned, spread)) >= 8 and np.mean(learned) > np.mean(spread)
    assert search.propose(box, points[:3], [None, float("nan"), -np.inf]).keys() == box.keys()


def test_search_over_folds(spark, rows):
    """All types and both symbols in the same rounds; the best set is the best trial, and a fit with it is what tuning gives."""
    both = rows.unionByName(spark.createDataFrame(some_rows("B", 3, 150)))
    tuning = panel.Tuning(init_points=2, iterations=5, folds=2)
    made = panel.train_panel(both, NAMES, ["decision_tree", "lasso"], tuning=tuning)
    params = {(r.symbol, r.model): r.params for r in made.params.collect()}
    assert len(params) == 4 and made.failures.isEmpty()
    train = both.where("split = 'train'").withColumn("role", F.lit(panel.TRAIN))
    chosen = panel.chosen_features(train, NAMES)
    n = train.groupBy("symbol").agg(F.count("*").alias("n"))
    sums = lasso.staged_moments(train.drop("n").join(n, "symbol"), NAMES, 2)
    found = search.tune_by_folds(panel.pack(train, chosen, NAMES), sums, chosen, NAMES, ["decision_tree", "lasso"], tuning)
    trials = found.trials.toPandas()
    assert trials.groupby(["symbol", "model"]).trial.nunique().eq(7).all() and trials.score.notna().all()
    best = trials.sort_values(["score", "trial"], ascending=[False, True]).groupby(["symbol", "model"]).first()
    assert {k: v.params for k, v in best.iterrows()} == params


def test_search_without_a_score_is_a_failure(spark, rows):
    chosen = panel.chosen_features(rows, NAMES)
    nothing = lambda asked: asked.select("symbol", "model", "trial", F.lit(None).cast("double").alias("score"))
    found = search.run_search(chosen, {"lasso": models.SEARCH_BOUNDS["lasso"]}, nothing, 1, 1)
    assert found.best.isEmpty() and [(r.symbol, r.model, r.step) for r in found.failures.collect()] == [("A", "lasso", "search")]


def test_validation_search(make_bars):
    bars = make_bars({"A": [50 + i % 7 + i / 10 for i in range(200)], "B": [20 + i % 5 for i in range(80)]})
    tuned = search.tune_on_validation(supervised_frame(bars), ["open", "high", "low"], models.MODEL_TYPES, init_points=1, iterations=1)
    assert tuned.predictions.count() == 4 * (199 + 79)
    assert {r.split for r in tuned.predictions.select("split").distinct().collect()} == {"train", "val", "test"}
    assert tuned.search.trials.count() == 16 and tuned.search.trials.filter("score > 0").isEmpty()


def test_search_inside_tasks_is_the_search_of_rounds(spark, rows, monkeypatch):
    """Small series go through their search inside a task, in as many jobs whatever the trials are; larger ones in rounds. Both find the same models; one without
    rows to learn from or with a value that is no number has trials without a score."""
    long = some_rows("B", 3, 150).assign(target=lambda f: f.target + 20)
    odd = some_rows("C", 5, 40).assign(a=float("nan"))
    frame = rows.withColumn("target", F.col("target") + 20).unionByName(spark.createDataFrame(pd.concat([long, odd, some_rows("D", 4, 1)])))

    boxes = {k: b | ({"n_estimators": (5, 30)} if "n_estimators" in b else {}) for k, b in models.VALIDATION_SEARCH_BOUNDS.items()}

    def tuned(iterations=5):
        return search.tune_on_validation(frame.drop("split"), NAMES, models.MODEL_TYPES, init_points=2, iterations=iterations, bounds=boxes)

    def jobs(iterations):
        spark.sparkContext.setJobGroup(f"search-{iterations}", "jobs are counted")
        try:
            return tuned(iterations), len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"search-{iterations}"))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    (small, many), (_, few) = jobs(5), jobs(1)
    assert many == few
    monkeypatch.setattr(search, "SMALL_SERIES", 400)  # B stays small
    mixed = tuned()
    key, kinds = ["symbol", "model", "trial"], sorted(models.MODEL_TYPES)
    trials = [t.search.trials.select(*key, "params", "share", "score").toPandas().sort_values(key, ignore_index=True) for t in (small, mixed)]
    assert trials[0].groupby("symbol").score.count().to_dict() == {"A": 28, "B": 28, "C": 0, "D": 0} and len(trials[0]) == 4 * 28
    before = [t[t.trial < 6].reset_index(drop=True) for t in trials]  # the last set may hang on scores that are equal but for rounding
    pd.testing.assert_frame_equal(before[0], before[1], rtol=1e-9)
    assert (trials[0].params == trials[1].params).mean() > 0.95
    assert sorted((r.symbol, r.model) for r in small.search.failures.collect()) == [(s, m) for s in "CD" for m in kinds]
    best = [{(r.symbol, r.model): r.params for r in t.search.best.collect()} for t in (small, mixed)]
    alike = [k for k in best[0] if best[0][k] == best[1][k]]
    assert len(best[0]) == 8 and len(alike) >= 6
    said = [t.predictions.select("symbol", "model", "pos", "prediction").toPandas().sort_values(["symbol", "model", "pos"], ignore_index=True) for t in (small, mixed)]
    assert len(said[0]) == 4 * (240 + 150)
    nodes = [t.nodes.groupBy("symbol", "model").agg(F.count("*").alias("n"), F.count("feature").alias("inner"), F.sum("rows").alias("rows"), F.sum("low").alias("low")).toPandas()
             .sort_values(["symbol", "model"], ignore_index=True) for t in (small, mixed)]
    for a, b in (said, nodes):
        some = [t[[k in alike for k in zip(t.symbol, t.model)]].reset_index(drop=True) for t in (a, b)]
        pd.testing.assert_frame_equal(*some, rtol=1e-9)


def test_trees_of_limits_are_those_of_a_smaller_fit():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(3, 120)).round(1), rng.normal(size=120)
    whole = trees.forest(x, y, range(30), 12, 2, 2)
    limits = [(12, 2, 30), (3, 2, 30), (12, 9, 17), (None, 40, 5), (1, 2, 0)]
    for (depth, least, count), (said, told) in zip(limits, trees.sums_of_limits(whole, x[:, :50], limits)):
        assert told == count
        if count:
            own, cut = trees.forest(x, y, range(count), depth or 12, least, 2), trees.stopped(whole, depth, least, count)
            assert said == pytest.approx(trees.leaf_values(own, x[:, :50]).sum(axis=0))
            for c in ("tree", "depth", "feature", "threshold", "low", "high", "value", "rows", "gain"):
                np.testing.assert_allclose(getattr(cut, c), getattr(own, c), rtol=1e-9, atol=1e-9, err_msg=c)


def test_linear_models_solved_together_are_what_they_are_alone():
    rng = np.random.default_rng(8)
    problems = []
    for k, width in enumerate((3, 4, 3, 4, 4)):
        x = rng.normal(size=(width, 60)) * 10.0 ** rng.integers(-2, 3, size=(width, 1))
        x[k % width] = 5.0 if k == 1 else x[k % width]  # a constant feature
        problems += [(panel.moments_of(x, x.sum(axis=0) + rng.normal(size=60)), alpha, most, tol) for alpha, most, tol in ((0.001, 5000, 1e-9), (0.5, 3, 1e-9), (1e9, 10, 1e-4))]
    for (sums, alpha, most, tol), (w, b) in zip(problems, lasso.descend_together(problems)):
        alone = lasso.descend(sums, [alpha], most, tol)
        assert (w == alone[0][0]).all() and b == alone[1][0]


# forecasts

def test_single_model_path_and_equal_weights(spark):
    rows = spark.createDataFrame([("A", 1, "lasso", 5.0), ("A", 1, "xgboost", 7.0), ("B", 1, "lasso", 2.0)], "symbol string, date int, model string, prediction double")
    got = {r.symbol: r for r in forecast.first_model(rows, ["xgboost", "lasso"]).collect()}
    assert (got["A"].predicted_value, got["A"].model_used) == (7.0, "xgboost") and got["B"].model_used == "lasso"
    weights = spark.createDataFrame([("B", "lasso", 1.0)], "symbol string, model string, weight double")
    assert {r.symbol: r.predicted_value for r in forecast.combine(rows, weights).collect()} == {"A": 6.0, "B": 2.0}


def test_complete_experiment_of_all_types(spark, make_bars, tmp_path):
    rng = np.random.default_rng(3)
    bars = make_bars({"A": list(100 + rng.normal(size=400).cumsum().round(2)), "B": list(50 + rng.normal(size=300).cumsum().round(2))})
    config = pipeline.PipelineConfig(
        feature_window=2, cross_validation_folds=2, enable_tuning=True, tuning_init=1, tuning_iterations=1,
        model_params={"random_forest": {"n_estimators": 10}, "xgboost": {"n_estimators": 10}})
    out = pipeline.run_experiment(bars, config, 10, str(tmp_path), at=datetime(2024, 1, 1))
    assert out.experiment_id.startswith("exp_20240101_000000_A_B_decision_tree_random_forest_")
    assert out.experiment_id != pipeline.experiment_id(["A", "B"], list(config.model_types), datetime(2024, 1, 1))
    log = spark.read.parquet(f"{tmp_path}/runs")
    assert log.where("kind = 'status' AND value = 'finished'").count() == 8 and log.where("kind = 'artifact'").count() == 8
    rows = out.predictions.toPandas()
    assert len(rows) == 20 and rows.actual_value.notna().sum() == 18 and (rows.confidence_lower <= rows.predicted_value).all()
    assert out.summary.where("symbol = 'A'").first().total_predictions == 10
    assert log.where("key = 'lasso_A_test_mse'").count() == 1 and log.where("key = 'xgboost_B_params'").count() == 1
    again = panel.TrainedPanel.load(spark, f"{tmp_path}/models/{out.experiment_id}")
    assert again.fitted().count() == 8
    pipeline.save_preprocessor(out.prepared, str(tmp_path / "prep"))
    back = pipeline.load_preprocessor(spark, str(tmp_path / "prep"), out.prepared.frame, out.prepared.spec)
    assert back.features_by_symbol() == out.prepared.features_by_symbol()
