"""Technical indicators as column expressions over a laid-out series (see layout).

Each function takes a WindowLayer and returns {name: Column}. Indicators that need a second pass over a first
result (strength index, signal line, slow stochastic) are built on a later layer over the first one's columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from barline.functions.columns import ema_lookback, ratio
from barline.functions.windows import SERIES, SO_FAR, WindowLayer
from barline.operators.layout import widest_segment


def moving_averages(layer: WindowLayer, c: str = "close", windows: Sequence[int] = (5, 10, 20, 50)):
    out = {}
    for n in windows:
        mean = layer.full(c, n, "avg")
        out[f"MA_{n}"] = mean
        out[f"MA_{n}_ratio"] = ratio(c, mean)
    return out


def _decay(span: int) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def _weights_stay_finite(span: int, back: int, ahead: int) -> bool:
    return -math.log(_decay(span)) * widest_segment(back, ahead) < 640


def ema(layer: WindowLayer, c: str, span: int, back: int, ahead: int = 0) -> Column:
    """Exponential mean with bias-corrected weights, y_t = sum(d^i x_(t-i)) / sum(d^i).

    Both sums are running sums of x * d^-row inside the segment, so a row costs two additions whatever the span.
    Segments are short enough for d^-row to stay finite; for the few tiny spans where it would not, the
    history that still carries weight is short and is folded directly. Reads the column `_row`, the row's
    number in its segment. Missing values keep their place in the decay and repeat the last mean.
    """
    if span <= 1:
        return layer.add(f"_ema_{c}_{span}", f"last(`{c}`, true) OVER ({SO_FAR})")
    if _weights_stay_finite(span, back, ahead):
        weight = f"pow({1.0 / _decay(span)!r}D, _row)"
        num = layer.add(f"_ema_num_{c}_{span}", f"sum(`{c}` * {weight}) OVER ({SO_FAR})")
        den = layer.add(f"_ema_den_{c}_{span}", f"sum(CASE WHEN `{c}` IS NOT NULL THEN {weight} END) OVER ({SO_FAR})")
        return num / den
    decay = _decay(span)
    frame = f"{SERIES} ROWS BETWEEN {ema_lookback(span)} PRECEDING AND CURRENT ROW"
    recent = f"collect_list(named_struct('x', `{c}`)) OVER ({frame})"
    zero = F.struct(F.lit(0.0).alias("num"), F.lit(0.0).alias("den"))
    return F.aggregate(
        layer.add(f"_recent_{c}_{span}", recent), zero,
        lambda s, e: F.struct(
            (s.num * decay + F.coalesce(e.x, F.lit(0.0))).alias("num"),
            (s.den * decay + e.x.isNotNull().cast("double")).alias("den"),
        ),
        lambda s: F.try_divide(s.num, s.den),
    )


def exponential_moving_averages(layer: WindowLayer, c: str, spans: Sequence[int], back: int, ahead: int = 0):
    return {f"EMA_{s}": ema(layer, c, s, back, ahead) for s in spans}


def price_moves(layer: WindowLayer, c: str = "close") -> dict[str, Column]:
    """Returns, and the gain and loss parts of the one-row change (0 on the first row)."""
    before = layer.lag(c, 1)
    change = F.col(c) - before
    quotient = ratio(c, before)
    return {
        "returns": quotient - 1,
        "log_returns": F.ln(quotient),
        "gain": F.when(change > 0, change).otherwise(0.0),
        "loss": F.when(change < 0, -change).otherwise(0.0),
    }


def rsi(layer: WindowLayer, window: int = 14) -> Column:
    """Strength index on simple means of gain and loss: 100 without losses, NULL without any move."""
    gain = layer.full("gain", window, "avg")
    loss = layer.full("loss", window, "avg")
    return F.when((loss == 0) & (gain > 0), 100.0).otherwise(100 - 100 / (1 + ratio(gain, loss)))


def bollinger_bands(layer: WindowLayer, c: str = "close", window: int = 20, num_std: float = 2):
    middle = layer.full(c, window, "avg")
    spread = layer.full(c, window, "std") * num_std
    upper, lower = middle + spread, middle - spread
    return {
        "BB_upper": upper,
        "BB_middle": middle,
        "BB_lower": lower,
        "BB_width": upper - lower,
        "BB_position": ratio(F.col(c) - lower, upper - lower),
    }


def stochastic_k(layer: WindowLayer, window: int = 14) -> Column:
    lowest = layer.full("low", window, "min")
    highest = layer.full("high", window, "max")
    return 100 * ratio(F.col("close") - lowest, highest - lowest)


def rolling_spread(layer: WindowLayer, c: str, windows: Sequence[int], extremes: bool = True):
    out = {}
    for n in windows:
        out[f"{c}_std_{n}"] = layer.full(c, n, "std")
        if extremes:
            out[f"{c}_min_{n}"] = layer.full(c, n, "min")
            out[f"{c}_max_{n}"] = layer.full(c, n, "max")
    return out


def lags(layer: WindowLayer, c: str, upto: int) -> dict[str, Column]:
    return {f"{c}_lag_{k}": layer.lag(c, k) for k in range(1, upto + 1)}


def lagged_returns(layer: WindowLayer, c: str, upto: int) -> dict[str, Column]:
    """Lags of the returns, taken from the lags of their prices: no second pass."""
    return {f"returns_lag_{k}": ratio(layer.lag(c, k), layer.lag(c, k + 1)) - 1 for k in range(1, upto + 1)}


def volume_features(layer: WindowLayer, window: int = 20) -> dict[str, Column]:
    return {
        "volume_ma_ratio": ratio("volume", layer.full("volume", window, "avg")),
        "price_volume": F.col("close") * F.col("volume"),
    }


def bar_shape() -> dict[str, Column]:
    return {
        "price_range": ratio(F.col("high") - F.col("low"), "close"),
        "price_change": ratio(F.col("close") - F.col("open"), "open"),
    }
