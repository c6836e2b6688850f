"""The feature frame: indicators, lags and target of every symbol, computed over one shared window spec."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.columns import ema_lookback, ratio
from barline.functions.windows import SEGMENT, SERIES, SO_FAR, WindowLayer
from barline.operators import indicators as ind
from barline.operators.layout import drop_copies, lay_out, positions, series

@dataclass(frozen=True)
class FeatureSpec:
    feature_window: int = 7
    horizon: int = 1
    target: str = "close"
    spans: tuple[int, ...] = (12, 26)
    macd: tuple[int, int, int] = (12, 26, 9)
    bollinger: tuple[int, float] = (20, 2)
    stochastic: tuple[int, int] = (14, 3)
    rsi_window: int = 14
    # Windows of short series first; series of at least `long_series` rows also get the remaining ones.
    ma_windows: tuple[int, ...] = (5, 10)
    long_ma_windows: tuple[int, ...] = (20, 50)
    stat_windows: tuple[int, ...] = (5, 10)
    long_stat_windows: tuple[int, ...] = (20,)
    long_series: int = 1000
    short_series: int = 100  # usable rows below which gaps are forward-filled and incomplete rows dropped
    volume: bool = True

    @property
    def back(self) -> int:
        """Rows of history that any feature depends on."""
        fast, slow, signal = self.macd
        widest = max(*self.ma_windows, *self.long_ma_windows, *self.stat_windows, *self.long_stat_windows,
                     self.bollinger[0], sum(self.stochastic), self.rsi_window, 20)
        return max(
            max(ema_lookback(s) for s in (*self.spans, fast, slow)) + ema_lookback(signal),
            widest + 1,
            self.feature_window + 1,
        )

    @property
    def names(self) -> list[str]:
        """Feature columns. Names and order (the order breaks ties in feature selection)."""
        out = ["returns", "log_returns", "price_range", "price_change"]
        if self.volume:
            out += ["volume_ma_ratio", "price_volume"]
        for n in (*self.ma_windows, *self.long_ma_windows):
            out += [f"MA_{n}", f"MA_{n}_ratio"]
        for s in self.spans:
            out += [f"EMA_{s}", f"EMA_{s}_ratio"]
        out += ["RSI", "MACD", "MACD_signal", "MACD_histogram"]
        out += ["BB_upper", "BB_middle", "BB_lower", "BB_width", "BB_position", "Stoch_K", "Stoch_D"]
        for k in range(1, self.feature_window + 1):
            out += [f"close_lag_{k}", f"returns_lag_{k}"] + ([f"volume_lag_{k}"] if self.volume else [])
        for n in (*self.stat_windows, *self.long_stat_windows):
            out += [f"close_std_{n}", f"returns_std_{n}", f"close_min_{n}", f"close_max_{n}"]
        return out

    def gate(self, name: str) -> str:
        """Condition on the series length `n` under which a feature exists."""
        long_only = {f"MA_{w}{tail}" for w in self.long_ma_windows for tail in ("", "_ratio")} | {
            f"{kind}_{w}" for w in self.long_stat_windows
            for kind in ("close_std", "returns_std", "close_min", "close_max")
        }
        if name in long_only:
            return f"n >= {self.long_series}"
        if name == "RSI" or name.startswith("Stoch"):
            return "n > 20"
        if name.startswith("MACD"):
            return "n > 30"
        if name.startswith("BB_"):
            return "n > 25"
        return "true"


KEYS = ["symbol", "date"]


def volume_features(layer: WindowLayer, spec: FeatureSpec) -> dict[str, Column]:
    return {**ind.volume_features(layer), **ind.lags(layer, "volume", spec.feature_window)}


def engineer_features(bars: DataFrame, spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    """symbol, date, close, every feature of `spec`, target, pos, n, segment; one row per bar.

    Rows whose target lies beyond the series keep a NULL target: they are what a forecast is made from.
    Features that a series is too short for are NULL. One Exchange and one Sort serve all windows.
    """
    back, ahead = spec.back, spec.horizon
    fast, slow, signal = spec.macd
    ma = (*spec.ma_windows, *spec.long_ma_windows)
    stats = (*spec.stat_windows, *spec.long_stat_windows)
    columns = [*KEYS, "open", "high", "low", "close", *(["volume"] if spec.volume else [])]
    laid = lay_out(bars.select(*columns), back, ahead)

    # Two window layers: over the bars, and over what the first one gave. Columns are derived as late as they can be where
    # that lets a reader of only their NULLs do without their frames, else between the layers: generated code for all of
    # them at once is longer than the 8,000 bytes up to which the JVM compiles a method.
    one = WindowLayer()
    spread = ind.rolling_spread(one, "close", stats)
    first = one.apply(laid.withColumn("_row", F.col("seg_row")), {
        "target": one.lead(spec.target, spec.horizon),
        **ind.price_moves(one),
        **ind.exponential_moving_averages(one, "close", sorted({*spec.spans, fast, slow}), back, ahead),
        **ind.moving_averages(one, windows=ma),
        **ind.bollinger_bands(one, window=spec.bollinger[0], num_std=spec.bollinger[1]),
        **ind.lags(one, "close", spec.feature_window),
        **ind.lagged_returns(one, "close", spec.feature_window),
        **(volume_features(one, spec) if spec.volume else {}),
        **ind.bar_shape(),
        "Stoch_K": ind.stochastic_k(one, spec.stochastic[0]),
    }).withColumns({
        "MACD": F.col(f"EMA_{fast}") - F.col(f"EMA_{slow}"),
        **{f"EMA_{s}_ratio": ratio("close", f"EMA_{s}") for s in spec.spans},
    })
    two = WindowLayer(below=one)
    signal_line = ind.ema(two, "MACD", signal, back, ahead)
    second = two.apply(first, {
        **spread,
        **ind.rolling_spread(two, "returns", stats, extremes=False),
        "RSI": ind.rsi(two, spec.rsi_window),
        "Stoch_D": two.full("Stoch_K", spec.stochastic[1], "avg"),
        "MACD_signal": signal_line,
        "MACD_histogram": F.col("MACD") - signal_line,
    })

    gated = [f"CASE WHEN {spec.gate(c)} THEN `{c}` END AS `{c}`" for c in spec.names]
    return drop_copies(second).selectExpr(*KEYS, "close", *gated, "target", "pos", "n", "segment")


def training_rows(features: DataFrame, spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    """Rows with a target and at least one feature; `pos` and `n` are renumbered over the rows that stay.

    A series left with fewer than `short_series` such rows is forward-filled and loses its incomplete rows. Complete means:
    no NULL in any feature that exists for the series (gated-off features, and volume features of a series
    without any volume, do not count). Such a series lies in one segment, so the fill needs no further shuffle.
    """
    names = spec.names
    # The exponential means exist on every row, so no row is without features. Prices are never NULL, so the rows
    # without a target are the last `horizon` ones; for other targets they are counted.
    usable = "target IS NOT NULL"
    priced = spec.target in ("open", "high", "low", "close")
    if priced:
        usable_rows = f"greatest(n - {spec.horizon}, 0L)"
    else:
        counts = features.groupBy("symbol").agg(F.expr(f"count_if({usable}) AS _counted"))
        features, usable_rows = features.join(counts, "symbol"), "_counted"

    # One window pass: last known value of every feature among the usable rows, used by short series only.
    last = [f"last(CASE WHEN {usable} THEN `{c}` END, true) OVER ({SO_FAR}) AS `_last_{c}`" for c in names]
    volume = f"max(price_volume IS NOT NULL) OVER ({SEGMENT})" if spec.volume else "false"
    seen = features.selectExpr("*", *last, f"{volume} AS _has_volume", f"{usable_rows} AS _usable_rows")
    active = {c: spec.gate(c) + (" AND _has_volume" if "volume" in c else "") for c in names}
    gaps = ", ".join(f"{active[c]} AND `_last_{c}` IS NULL" for c in names)
    short = f"_usable_rows < {spec.short_series}"
    kept = seen.where(f"{usable} AND (NOT {short} OR NOT array_contains(array({gaps}), true))")
    numbered = kept.selectExpr(
        *KEYS, "close", *[f"CASE WHEN {short} THEN `_last_{c}` ELSE `{c}` END AS `{c}`" for c in names], "target",
        f"CASE WHEN {short} THEN row_number() OVER ({SERIES}) ELSE pos END AS pos",
        f"CASE WHEN {short} THEN count(*) OVER ({SEGMENT}) ELSE _usable_rows END AS n",
    )
    return numbered if priced else positions(numbered.drop("pos", "n"))


def supervised_frame(bars: DataFrame, target: str = "close", horizon: int = 1) -> DataFrame:
    """Raw columns as features, `target` moved to the label `horizon` rows ahead; the last rows fall away."""
    laid = lay_out(bars, ahead=horizon)
    moved = laid.withColumn("label", F.lead(target, horizon).over(series()))
    others = [c for c in bars.columns if c not in (*KEYS, target)]
    return drop_copies(moved).where(F.col("label").isNotNull()).select(
        *KEYS, *others, F.col("label").alias("target"), F.col("pos"), (F.col("n") - horizon).alias("n")
    )


def null_budget(features: DataFrame, spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    """Per symbol: rows, NULLs over all features that exist for the series, NULL targets."""
    blanks = F.expr(" + ".join(f"int({spec.gate(c)} AND `{c}` IS NULL)" for c in spec.names))
    # Told apart row by row before they are summed: in a projection the optimizer sees what makes a feature NULL.
    rows = features.select("symbol", blanks.alias("blanks"), F.col("target").isNull().alias("no_target"))
    return rows.groupBy("symbol").agg(
        F.count("*").alias("rows"),
        F.sum("blanks").alias("feature_nulls"),
        F.count_if("no_target").alias("target_nulls"),
    )
