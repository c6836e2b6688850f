import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.functions.windows import WindowLayer
from barline.operators import indicators as ind
from barline.operators.features import FeatureSpec, engineer_features, null_budget, supervised_frame, training_rows
from barline.operators.layout import drop_copies, lay_out, positions, segment_plan, widest_segment
from barline.operators.splits import split_by_fraction


def walk(n, seed=0):
    return list(100 + np.cumsum(np.random.default_rng(seed).normal(size=n)).round(2) + 0.02 * np.arange(n))


@pytest.fixture(scope="module")
def long_bars(make_bars):
    return make_bars({"A": walk(5000), "B": walk(700, 1), "C": walk(12, 2)}, step=3)


def by_symbol(df, symbol):
    return df.where(F.col("symbol") == symbol).toPandas().sort_values("date").reset_index(drop=True)


def test_positions_and_segment_bounds(long_bars):
    rows = positions(long_bars).toPandas()
    for symbol, part in rows.groupby("symbol"):
        part = part.sort_values("date")
        assert part.pos.tolist() == list(range(1, len(part) + 1))
        assert (part.n == len(part)).all()
    sizes = lay_out(long_bars, 700, 5).groupBy("symbol", "segment").count().toPandas()
    assert sizes["count"].max() <= widest_segment(700, 5)
    assert (sizes.symbol == "A").sum() == 3
    assert drop_copies(lay_out(long_bars, 700, 5)).count() == long_bars.count()


def test_copies_cover_the_lookback(long_bars):
    laid = lay_out(long_bars, 700, 5).where("symbol = 'A'").toPandas()
    for _, part in laid.groupby("segment"):
        core = part[part.core]
        first, last = core.pos.min(), core.pos.max()
        assert set(range(max(1, first - 700), first)) <= set(part.pos)
        assert set(range(last + 1, min(5000, last + 5) + 1)) <= set(part.pos)


def test_plan_is_small(long_bars):
    assert segment_plan(long_bars, 700, 5).count() <= long_bars.count() // 10


def test_features_match_pandas_across_segments(long_bars):
    features = engineer_features(long_bars)
    for symbol in ("A", "B"):
        got = by_symbol(features, symbol)
        src = by_symbol(long_bars, symbol)
        x = src.close
        ema12, ema26 = x.ewm(span=12).mean(), x.ewm(span=26).mean()
        macd = ema12 - ema26
        delta = x.diff()
        gain = delta.where(delta > 0, 0.0).rolling(14).mean()
        loss = (-delta.where(delta < 0, 0.0)).rolling(14).mean()
        low, high = src.low.rolling(14).min(), src.high.rolling(14).max()
        k = 100 * (x - low) / (high - low)
        expected = {
            "EMA_12": ema12, "EMA_26": ema26, "MACD": macd, "MACD_signal": macd.ewm(span=9).mean(),
            "RSI": 100 - 100 / (1 + gain / loss), "Stoch_K": k, "Stoch_D": k.rolling(3).mean(),
            "MA_10": x.rolling(10).mean(), "close_std_5": x.rolling(5).std(), "returns": x.pct_change(),
            "close_lag_7": x.shift(7), "target": x.shift(-1),
            "BB_upper": x.rolling(20).mean() + 2 * x.rolling(20).std(),
            "returns_std_10": x.pct_change().rolling(10).std(),
        }
        for name, want in expected.items():
            np.testing.assert_allclose(
                got[name].astype(float), want, rtol=1e-9, atol=1e-9, err_msg=f"{symbol} {name}")
        assert got.MA_50.notna().any() == (symbol == "A")


def test_small_span_uses_the_fold(long_bars):
    layer_one, layer_two = WindowLayer(), WindowLayer()
    laid = layer_one.apply(lay_out(long_bars, 120), {"_row": layer_one.row()})
    out = drop_copies(layer_two.apply(laid, {"e": ind.ema(layer_two, "close", 3, 120)}))
    got = by_symbol(out, "A")
    np.testing.assert_allclose(got.e, got.close.ewm(span=3).mean(), rtol=1e-12)


def test_missing_values_keep_their_place_in_the_mean(spark, make_bars):
    bars = make_bars({"A": walk(40)}).withColumn("close", F.when(F.dayofmonth("date") % 5 != 0, F.col("close")))
    one, two = WindowLayer(), WindowLayer()
    laid = one.apply(lay_out(bars, 300), {"_row": one.row()})
    got = by_symbol(drop_copies(two.apply(laid, {"e": ind.ema(two, "close", 12, 300)})), "A")
    np.testing.assert_allclose(got.e, got.close.ewm(span=12).mean(), rtol=1e-12)


@pytest.mark.parametrize("window, features, nulls", [(3, 50, 15401), (5, 56, 21403)])
def test_null_budget_of_a_long_series(make_bars, window, features, nulls):
    spec = FeatureSpec(feature_window=window)
    bars = make_bars({"A": walk(2991)}, volume=float("nan"))
    assert len(spec.names) == features
    row = null_budget(engineer_features(bars, spec), spec).first()
    assert (row.rows, row.feature_nulls, row.target_nulls) == (2991, nulls, 1)


def test_split_sizes(make_bars):
    rows = training_rows(engineer_features(make_bars({"A": walk(2991)}, volume=float("nan"))))
    sizes = {r.split: r["count"] for r in split_by_fraction(rows).groupBy("split").count().collect()}
    assert sizes == {"train": 1914, "val": 478, "test": 598}


def test_flat_series_has_no_division_errors(make_bars):
    got = by_symbol(engineer_features(make_bars({"A": [5.0] * 60})), "A")
    assert got.RSI.isna().all() and got.BB_position.isna().all()
    assert (got.returns.dropna() == 0).all()


def test_rising_series_has_full_strength(make_bars):
    got = by_symbol(engineer_features(make_bars({"A": [float(i) for i in range(1, 61)]})), "A")
    assert (got.RSI.dropna() == 100).all() and got.RSI.notna().sum() == 60 - 13


def test_short_series_is_filled_and_renumbered(make_bars):
    bars = make_bars({"A": walk(60)}).withColumn("volume", F.when(F.dayofmonth("date") != 20, F.col("volume")))
    rows = by_symbol(training_rows(engineer_features(bars)), "A")
    active = [c for c in FeatureSpec().names if FeatureSpec().gate(c) != "n >= 1000"]
    assert rows[[*active, "target"]].notna().all().all() and rows.MA_50.isna().all()
    assert rows.pos.tolist() == list(range(1, len(rows) + 1)) and (rows.n == len(rows)).all()


def test_short_series_without_volume_keeps_rows(make_bars):
    rows = training_rows(engineer_features(make_bars({"A": walk(60)}, volume=None)))
    assert rows.count() == 60 - 19 - 1


def test_single_row_symbol(make_bars):
    features = engineer_features(make_bars({"A": [1.0], "B": walk(30)}))
    assert by_symbol(features, "A").shape[0] == 1
    assert training_rows(features).where("symbol = 'A'").count() == 0


def test_nullable_target_is_renumbered(make_bars):
    spec = FeatureSpec(target="volume")
    bars = make_bars({"A": walk(300)}).withColumn("volume", F.when(F.dayofmonth("date") != 9, F.col("volume")))
    rows = by_symbol(training_rows(engineer_features(bars, spec), spec), "A")
    assert rows.target.notna().all() and rows.pos.tolist() == list(range(1, len(rows) + 1))


def test_supervised_frame(make_bars):
    rows = by_symbol(supervised_frame(make_bars({"A": [1.0, 2.0, 3.0, 4.0]}), horizon=2), "A")
    assert rows.target.tolist() == [3.0, 4.0] and (rows.n == 2).all() and "close" not in rows


def test_one_shuffle_serves_all_windows(make_bars):
    bars = make_bars({"A": walk(50)})
    plan = engineer_features(bars)._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(symbol" in line and "segment" in line]
    assert len(wide) == 1


def test_null_budget_leaves_out_frames_of_unread_values(make_bars):
    plan = null_budget(engineer_features(make_bars({"A": walk(50)})))._jdf.queryExecution().optimizedPlan().toString()
    assert "stddev_samp(close" in plan  # the place in the band is NULL for an empty band
    assert "stddev_samp(returns" not in plan and "min(close" not in plan and "max(close" not in plan


@pytest.mark.parametrize("build", [engineer_features, lambda bars: null_budget(engineer_features(bars))])
def test_generated_methods_are_small_enough_to_be_compiled(spark, make_bars, build, capsys):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # adaptive plans generate their code as they run
    try:
        build(make_bars({"A": walk(50)})).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(s) for s in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000


def test_frames_with_gaps_match_pandas(make_bars):
    bars = make_bars({"A": walk(2500)}).withColumn("volume", F.when(F.dayofyear("date") % 37 != 0, F.dayofmonth("date") + 0.0))
    features = engineer_features(bars)
    got, src = by_symbol(features, "A"), by_symbol(bars, "A")
    want = src.volume / src.volume.rolling(20).mean()
    np.testing.assert_allclose(got.volume_ma_ratio.astype(float), want, rtol=1e-9)
    for k in (1, 7):
        np.testing.assert_allclose(got[f"returns_lag_{k}"].astype(float), src.close.pct_change().shift(k), rtol=1e-12, atol=1e-15)
    names = [c for c in FeatureSpec().names]
    assert null_budget(features).first().feature_nulls == got[names].isna().sum().sum()
