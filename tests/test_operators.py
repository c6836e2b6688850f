from datetime import date

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barline.operators import evaluate, forecast, prepare, splits, validate
from barline.operators.evaluate import MetricInputError
from barline.operators.layout import positions
from barline.operators.quantiles import exact_quantiles

# ---- metrics ------------------------------------------------------------------------------------------------------


def sides(spark, real, pred, dataset="train"):
    a = spark.createDataFrame([(dataset, i, float(v)) for i, v in enumerate(real)], "dataset string, id int, y_real double")
    b = spark.createDataFrame([(dataset, i, None if v is None else float(v)) for i, v in enumerate(pred)], "dataset string, id int, y_pred double")
    return a, b


def request(**changes):
    base = {"problem_type": "regression", "metrics": ("rmse", "r2", "mape", "mse"), "results_file_name": "m",
            "results_structure": "single_row", "comment": "test", "save": False}
    return {**base, **changes}


# Metric cases with known results.
HALF = [0, 0, 0, 0, 1, 1, 1, 1]


@pytest.mark.parametrize("real, pred, expected", [
    (HALF, HALF, {"rmse": 0, "r2": 1, "mape": 0, "mse": 0}),
    ([1] * 8, [0] * 8, {"rmse": 1, "r2": 0, "mape": 1, "mse": 1}),
    ([1] * 8, [1] * 6 + [0.5] * 2, {"rmse": 0.25, "r2": 0, "mape": 0.125, "mse": 0.0625}),
])
def test_regression_metrics(spark, real, pred, expected):
    row = evaluate.calculate_metrics(*sides(spark, real, pred, "val"), request()).first()
    assert {k: row[f"{k}_val"] for k in expected} == pytest.approx(expected)
    assert row.comment == "test"


@pytest.mark.parametrize("real, pred, expected", [
    (HALF, HALF, dict(acc=1, b_acc=1, recall=1, f1=1, precision=1)),
    ([1] * 8, [0] * 8, dict(acc=0, b_acc=0, recall=0, f1=0, precision=0)),
    ([1] * 8, [1] * 4 + [0] * 4, dict(acc=0.5, b_acc=0.5, recall=0.25, f1=2 / 3, precision=1)),
])
def test_classification_metrics(spark, real, pred, expected):
    meta = request(problem_type="classification", metrics=tuple(expected), results_structure="multiple_rows")
    row = evaluate.calculate_metrics(*sides(spark, real, pred), meta).first()
    assert {k: row[k] for k in expected} == pytest.approx(expected)


@pytest.mark.parametrize("changes, reason", [
    ({"problem_type": "other"}, "problem_type_not_implemented"),
    ({"metrics": ("rmse", "other")}, "metric_not_implemented"),
    ({"results_structure": "other"}, "wrong_results_structure"),
])
def test_bad_request(spark, changes, reason):
    with pytest.raises(MetricInputError) as e:
        evaluate.calculate_metrics(*sides(spark, HALF, HALF), request(**changes))
    assert e.value.reason == reason


def test_missing_request_key(spark):
    meta = request()
    del meta["comment"]
    with pytest.raises(MetricInputError, match="metadata_key_missing"):
        evaluate.calculate_metrics(*sides(spark, HALF, HALF), meta)


def bad_inputs(spark):
    good = sides(spark, HALF, HALF)
    shifted = good[1].withColumn("id", F.col("id") + 1)
    return {
        "empty": (good[0].limit(0), good[1].limit(0)),
        "incompatible_lengths": (good[0], good[1].where("id > 0")),
        "missing_values": sides(spark, HALF, [*HALF[:7], None]),
        "wrong_type": (HALF, HALF),
        "wrong_values_type": (good[0].withColumn("y_real", F.col("y_real").cast("string")), good[1]),
        "index_mismatch": (good[0], shifted),
        "wrong_dataset_name": sides(spark, HALF, HALF, "other"),
    }


@pytest.mark.parametrize("reason", [
    "empty", "incompatible_lengths", "missing_values", "wrong_type", "wrong_values_type", "index_mismatch", "wrong_dataset_name"])
def test_bad_input(spark, reason):
    with pytest.raises(MetricInputError) as e:
        evaluate.calculate_metrics(*bad_inputs(spark)[reason], request())
    assert e.value.reason == reason


def test_comparison_and_best_model(spark):
    rows = [("A", m, s, k, v) for m, base in (("x", 2.0), ("y", 1.0)) for s in ("test", "val") for k, v in (("mse", base), ("r2", -base))]
    table = evaluate.compare_models(spark.createDataFrame(rows, "symbol string, model string, split string, metric string, value double"))
    assert [r.model for r in table.collect()] == ["y", "x"]
    assert evaluate.best_models(table).first().model == "y"
    assert evaluate.best_models(table, "test_r2", ascending=False).first().model == "y"


# ---- quantiles ----------------------------------------------------------------------------------------------------


def test_exact_quantiles_against_brute_force(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"k": np.where(rng.random(9000) < 0.6, "hot", "cold"), "v": rng.lognormal(size=9000).round(2)})
    frame.loc[frame.index % 50 == 0, "v"] = None
    got = exact_quantiles(spark.createDataFrame(frame).selectExpr("k", "nullif(v, double('NaN')) AS v"), "k", ["v"],
                          [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]).toPandas()
    assert len(got) == 14
    for r in got.itertuples():
        want = frame[frame.k == r.k].v.quantile(r.fraction)
        assert r.quantile == pytest.approx(want, rel=1e-12), (r.k, r.fraction)


# ---- splits -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def numbered(make_bars):
    return positions(make_bars({"A": [float(i) for i in range(103)], "B": [1.0] * 7, "C": [2.0]})).cache()


def sizes(df, *by):
    return {tuple(r[:-1]): r[-1] for r in df.groupBy(*by).count().collect()}


def test_ratio_split_leaves_rest_to_test(numbered):
    got = sizes(splits.split_by_ratio(numbered, {"train": 0.5, "validation": 0.2, "test": 0.1}), "symbol", "split")
    assert got[("A", "train")] == 51 and got[("A", "val")] == 21 and got[("A", "test")] == 31


def test_split_rule():
    assert splits.split_ratios(70, 20, 20) == splits.DEFAULT_RATIOS
    assert splits.split_ratios(50, 20, 10) == {"train": 0.5, "validation": 0.2, "test": 0.1}


def test_random_split_sizes_and_repeatability(numbered):
    out = splits.split_three_at_random(numbered)
    assert sizes(out, "symbol", "split")[("A", "test")] == 21
    again = splits.split_three_at_random(numbered)
    assert out.select("symbol", "date", "split").exceptAll(again.select("symbol", "date", "split")).count() == 0
    other = splits.split_three_at_random(numbered, seed=7)
    assert out.select("symbol", "date", "split").exceptAll(other.select("symbol", "date", "split")).count() > 0


def test_folds_never_look_ahead(numbered):
    folds = splits.expanding_folds(numbered.where("symbol = 'A'"), 5).toPandas()
    for i, part in folds.groupby("fold"):
        train, test = part[part.role == "train"].pos, part[part.role == "test"].pos
        assert len(test) == 103 // 6 and train.max() == test.min() - 1 and train.min() == 1
        assert test.min() == 103 - (5 - i) * 17 + 1


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 5000), st.floats(0.05, 0.5), st.floats(0.05, 0.5))
def test_fraction_cuts_follow_integer_arithmetic(n, t, v):
    test = int(n * t)
    val = int((n - test) * v)
    assert n - test - val >= 0 and test + val <= n


# ---- preparation --------------------------------------------------------------------------------------------------


def test_scalers_match_numpy(spark):
    x = np.array([1.0, 2.0, 4.0, 8.0, 100.0])
    rows = [("A", "train", float(v), 3.0) for v in x] + [("A", "test", 6.0, 3.0), ("A", "test", None, 3.0)]
    frame = spark.createDataFrame(rows, "symbol string, split string, x double, flat double")
    q1, q2, q3 = np.percentile(x, [25, 50, 75])
    for method, (centre, spread) in {
        "standard": (x.mean(), x.std()), "minmax": (1.0, 99.0), "robust": (q2, q3 - q1),
    }.items():
        got = prepare.scale(frame, ["x", "flat"], method).where("split = 'test'").toPandas()
        assert sorted(got.x) == pytest.approx(sorted([(6 - centre) / spread, 0.0]))
        assert (got.flat == 0).all()
    with pytest.raises(ValueError):
        prepare.scale(frame, ["x"], "other")


def test_outliers_become_the_median(spark):
    values = [1.0] * 10 + [2.0] * 10 + [500.0]
    frame = spark.createDataFrame([("A", "train", v) for v in values], "symbol string, split string, x double")
    got = prepare.replace_outliers(frame, ["x"]).toPandas().x
    assert got.max() == 2.0 and len(got) == 21


def test_feature_ties_go_to_the_later_column(spark):
    rows = [("A", float(i), 0.0, 0.0, float(i % 3)) for i in range(30)]
    frame = spark.createDataFrame(rows, "symbol string, target double, flat1 double, flat2 double, x double")
    scores = prepare.f_scores(frame, ["flat1", "flat2", "x"])
    assert [r.feature for r in prepare.top_features(scores, 2).orderBy("rank").collect()] == ["x", "flat2"]
    r = np.corrcoef([i % 3 for i in range(30)], range(30))[0, 1]
    assert scores.where("feature = 'x'").first().score == pytest.approx(r * r / (1 - r * r) * 28)


# ---- validation ---------------------------------------------------------------------------------------------------

HEADER = "dataset string, Date string, Open string, High string, Low string, Close string, Volume string, Extra string"


def raw(spark, rows):
    return spark.createDataFrame(rows, HEADER)


def clean(name, n=800, start=date(2018, 1, 1)):
    days = pd.date_range(start, periods=n)
    return [(name, f"{d:%Y-%m-%d} 23:59:59", "10", "12", "9", "11", "5", "x") for d in days]


def found(spark, rows, **kw):
    return {(r.check, r.column): (r.severity, r.n) for r in validate.findings(raw(spark, rows), **kw).collect()}


def test_clean_dataset_passes(spark):
    df = raw(spark, clean("ok"))
    out = validate.findings(df)
    assert {r.severity for r in out.collect()} == {"warning"}
    assert validate.verdicts(df, out).first().is_valid
    assert validate.first_failure(df).first().passed


@pytest.mark.parametrize("change, key, expected", [
    (lambda r: [*r, r[0]], ("duplicates", "date"), ("error", 1)),
    (lambda r: r[:100] + r[103:], ("gaps", "date"), ("warning", 1)),
    (lambda r: [(*r[0][:3], "8", *r[0][4:]), *r[1:]], ("high_below_low", "high"), ("error", 1)),
    (lambda r: [(*r[0][:5], "-1", *r[0][6:]), *r[1:]], ("negative", "close"), ("error", 1)),
    (lambda r: [(*r[0][:2], "0", *r[0][3:]), *r[1:]], ("zero", "open"), ("warning", 1)),
    (lambda r: [(*r[0][:5], "abc", *r[0][6:]), *r[1:]], ("type", "close"), ("error", 1)),
    (lambda r: [(*r[0][:6], "abc", r[0][7]), *r[1:]], ("type", "volume"), ("warning", 1)),
    (lambda r: [(r[0][0], "soon", *r[0][2:]), *r[1:]], ("type", "date"), ("error", 1)),
    (lambda r: [(*x[:5], None, *x[6:]) if i % 16 == 0 else x for i, x in enumerate(r)], ("missing", "close"), ("warning", 50)),
    (lambda r: [(*x[:5], None, *x[6:]) if i % 9 == 0 else x for i, x in enumerate(r)], ("missing", "close"), ("error", 89)),
    (lambda r: r[:100], ("length", "date"), ("error", 99)),
    (lambda r: [(*r[0][:5], "9000", *r[0][6:]), *r[1:]], ("outliers", "close"), ("warning", 1)),
])
def test_faults_are_found(spark, change, key, expected):
    assert found(spark, change(clean("d")))[key] == expected


def test_missing_and_unexpected_columns(spark):
    df = raw(spark, clean("d")).drop("Low")
    rows = {(r.check, r.column): r.severity for r in validate.findings(df).collect()}
    assert rows[("columns", "low")] == "error" and rows[("columns", "Extra")] == "warning"
    assert validate.first_failure(df).first().failed_check == "columns"


def test_empty_dataset_is_reported(spark):
    df = raw(spark, clean("a"))
    expected = spark.createDataFrame([("a",), ("b",)], "dataset string")
    out = validate.findings(df, expected=expected)
    verdict = {r.dataset: r.is_valid for r in validate.verdicts(df, out, expected).collect()}
    assert verdict == {"a": True, "b": False}


@pytest.mark.parametrize("change, failed", [
    (lambda r: [(*r[0][:2], None, *r[0][3:]), *r[1:]], ("missing", "open")),
    (lambda r: r[:729], ("length", "date")),
    (lambda r: [(*x[:6], None, x[7]) if i % 15 == 0 else x for i, x in enumerate(r)], ("completeness", "volume")),
    (lambda r: [(*r[0][:3], "8", *r[0][4:]), *r[1:]], ("prices", "")),
])
def test_fail_fast_order(spark, change, failed):
    row = validate.first_failure(raw(spark, change(clean("d")))).first()
    assert (row.failed_check, row.failed_column) == failed and not row.passed


def test_usual_step_prefers_the_smaller_on_ties(spark):
    days = ["2020-01-01", "2020-01-02", "2020-01-04", "2020-01-05", "2020-01-07"]
    steps = validate.day_steps(spark.createDataFrame([("d", x) for x in days], "dataset string, date string"))
    assert validate.usual_step(steps).first().usual_step == 1


# ---- forecasts ----------------------------------------------------------------------------------------------------


def test_asof_against_brute_force(spark):
    rng = np.random.default_rng(5)
    days = pd.date_range("1990-01-01", "2020-01-01")
    bars = pd.DataFrame([(s, d.date(), float(i)) for s in "AB" for i, d in enumerate(days) if rng.random() < 0.02], columns=["symbol", "date", "v"])
    asked = pd.DataFrame([(s, d.date()) for s in "ABC" for d in days if rng.random() < 0.03], columns=["symbol", "date"])
    got = forecast.asof_before(spark.createDataFrame(asked), spark.createDataFrame(bars)).toPandas()
    assert len(got) == len(asked)
    for r in got.sample(300, random_state=1).itertuples():
        earlier = bars[(bars.symbol == r.symbol) & (bars.date < r.date)]
        if earlier.empty:
            assert pd.isna(r.v)
        else:
            assert r.v == earlier.iloc[-1].v and r.asof_date == earlier.iloc[-1].date


def test_rows_before_takes_the_last_ones(spark, make_bars):
    bars = positions(make_bars({"A": [float(i) for i in range(50)]}))
    spine = spark.createDataFrame([("A", date(2015, 1, 11)), ("A", date(2014, 1, 1))], "symbol string, date date")
    rows = forecast.rows_before(spine, bars, 5).orderBy("pos").collect()
    assert [r.close for r in rows] == [5.0, 6.0, 7.0, 8.0, 9.0]


def test_ensemble(spark):
    val = spark.createDataFrame([("A", "x", 1.0, 2.0), ("A", "y", 1.0, 3.0)], "symbol string, model string, target double, prediction double")
    weights = forecast.ensemble_weights(val)
    w = {r.model: r.weight for r in weights.collect()}
    assert w["x"] == pytest.approx(0.8) and sum(w.values()) == pytest.approx(1)
    rows = spark.createDataFrame([("A", date(2020, 1, 1), "x", 10.0), ("A", date(2020, 1, 1), "y", 20.0)], "symbol string, date date, model string, prediction double")
    r = forecast.combine(rows, weights).first()
    assert r.predicted_value == pytest.approx(12) and r.confidence_upper - r.predicted_value == pytest.approx(1.96 * 5)
    assert forecast.combine(rows, method="simple_average").first().predicted_value == 15
    with pytest.raises(ValueError):
        forecast.ensemble_weights(val, "other")


def test_prediction_summary_pairs_rows(spark):
    rows = [("A", 10.0, None), ("A", 20.0, 22.0), ("B", 1.0, None)]
    got = {r.symbol: r for r in evaluate.prediction_summary(spark.createDataFrame(rows, "symbol string, predicted_value double, actual_value double")).collect()}
    assert got["A"].mse == 4 and got["A"].predictions_with_actuals == 1 and got["B"].mse is None


def test_the_first_of_several_faults_is_reported(spark):
    """Datasets are judged in order of their names, rules in their order, whatever order rows come in."""
    schema = "dataset string, id long, {} double"
    real = [("val", 1, None), ("train", 1, 1.0), ("train", 2, 2.0), ("other", 1, 1.0)]
    pred = [("val", 1, 1.0), ("train", 1, 1.0), ("other", 1, 1.0)]
    for rows in (real, real[::-1]):
        with pytest.raises(evaluate.MetricInputError) as e:
            evaluate.check_input(spark.createDataFrame(rows, schema.format("y_real")), spark.createDataFrame(pred, schema.format("y_pred")))
        assert e.value.reason == "wrong_dataset_name"
        with pytest.raises(evaluate.MetricInputError) as e:
            evaluate.check_input(
                spark.createDataFrame([r for r in rows if r[0] != "other"], schema.format("y_real")),
                spark.createDataFrame(pred[:2], schema.format("y_pred")))
        assert e.value.reason == "incompatible_lengths"


def test_quantiles_of_hot_constant_and_negative_groups(spark):
    """A group with nearly all rows and values that hardly repeat, one value, negative values, zeros of both signs, values of any size."""
    rng = np.random.default_rng(8)
    groups = {"big": rng.lognormal(size=20000), "small": rng.normal(size=50), "constant": np.full(500, 3.25), "negative": -rng.lognormal(3, 4, size=400),
              "zeros": np.array([-0.0, 0.0, -1e-300, 1e-300, 0.0]), "wide": rng.normal(size=300) * 10.0 ** rng.integers(-300, 300, 300), "one": np.array([-7.5])}
    frame = pd.DataFrame({"k": np.repeat(list(groups), [len(v) for v in groups.values()]), "v": np.concatenate(list(groups.values()))})
    fractions = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = exact_quantiles(spark.createDataFrame(frame), "k", ["v"], fractions).collect()
    assert len(got) == len(groups) * len(fractions)
    for r in got:
        assert r.quantile == pytest.approx(np.quantile(groups[r.k], r.fraction), rel=1e-12), (r.k, r.fraction)


def test_findings_scan_the_rows_once(spark, make_bars, tmp_path):
    make_bars({"a": [10.0 + i % 9 for i in range(800)], "b": [5.0] * 30}).withColumnRenamed("symbol", "dataset").write.parquet(str(tmp_path / "raw"))
    rows = spark.read.parquet(str(tmp_path / "raw"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    counted = rows.mapInArrow(count, rows.schema)
    found = validate.findings(counted)
    found.collect()
    assert seen.value == 830
    assert validate.outlier_counts(rows).count() == 2


def test_quantiles_of_small_groups_cross_one_shuffle(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame(pd.DataFrame({"k": np.repeat(["a", "b", "c"], [400, 40, 1]), "v": rng.normal(size=441).round(1), "u": 1.5}))
    fractions = [0.01, 0.25, 0.99]
    few = exact_quantiles(rows, "k", ["v", "u"], fractions)
    assert few._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    monkeypatch.setattr("barline.operators.quantiles.SORTED_AT_ONCE", 39)  # a and b by radix, c by sorting
    mixed = exact_quantiles(rows, "k", ["v", "u"], fractions)
    assert sorted(few.collect()) == sorted(mixed.collect())


def test_findings_of_large_and_small_datasets_agree(spark, make_bars, monkeypatch):
    """One row of the scan per raw row, and the same findings whichever way the outliers are counted."""
    closes = {"a": [10.0 + i % 9 for i in range(800)] + [900.0], "b": [5.0] * 30, "c": [7.0] * 2}
    raw = make_bars(closes).withColumnRenamed("symbol", "dataset")
    raw = raw.unionByName(raw.where("dataset = 'c'")).unionByName(raw.where("dataset = 'c'").withColumn("date", F.lit(None).cast("date")))
    assert validate.one_scan(raw).count() == raw.count()
    few = sorted(validate.findings(raw).collect())
    assert {(r.dataset, r.n) for r in few if r.check == "duplicates"} >= {("c", 3)}
    assert {(r.dataset, r.column) for r in few if r.check == "outliers"} >= {("a", "close")}
    monkeypatch.setattr("barline.operators.quantiles.SORTED_AT_ONCE", 35)
    assert sorted(validate.findings(raw).collect()) == few
