"""Named metrics as native aggregate columns: problem type -> name -> f(real, predicted)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: smallest denominator of the guarded percentage error (float64 machine epsilon).
EPSILON = 2.220446049250313e-16

Metric = Callable[[Column, Column], Column]


def mse(real: Column, pred: Column) -> Column:
    err = real - pred
    return F.avg(err * err)


def mae(real: Column, pred: Column) -> Column:
    return F.avg(F.abs(real - pred))


def rmse(real: Column, pred: Column) -> Column:
    return F.sqrt(mse(real, pred))


def r2(real: Column, pred: Column) -> Column:
    """1 - SSres/SStot; for constant actuals 1 when every residual is 0, else 0."""
    err = real - pred
    residual = F.sum(err * err)
    # A constant column can leave a tiny non-zero variance through rounding, so constancy is tested on min/max.
    constant = F.min(real) == F.max(real)
    total = F.var_pop(real) * F.count(real)
    return (
        F.when(constant & (residual == 0), F.lit(1.0))
        .when(constant, F.lit(0.0))
        .otherwise(1 - F.try_divide(residual, total))
    )


def mape(real: Column, pred: Column) -> Column:
    """Mean absolute percentage error as a fraction, denominator floored at machine epsilon."""
    return F.avg(F.abs(real - pred) / F.greatest(F.abs(real), F.lit(EPSILON)))


def mape_pct(real: Column, pred: Column) -> Column:
    """Mean absolute percentage error times 100 without a guard: NULL terms where the actual is 0."""
    return F.avg(F.abs(F.try_divide(real - pred, real))) * 100


def _hits(real: Column, pred: Column, label: int) -> Column:
    return F.count_if((real == label) & (pred == label)).cast("double")


def _share(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num, den.cast("double")), F.lit(0.0))


def accuracy(real: Column, pred: Column) -> Column:
    return F.avg((real == pred).cast("double"))


def precision(real: Column, pred: Column) -> Column:
    return _share(_hits(real, pred, 1), F.count_if(pred == 1))


def f1(real: Column, pred: Column) -> Column:
    return _share(2 * _hits(real, pred, 1), F.count_if(real == 1) + F.count_if(pred == 1))


def _recalls(real: Column, pred: Column) -> dict[int, Column]:
    return {k: _share(_hits(real, pred, k), F.count_if(real == k)) for k in (0, 1)}


def balanced_accuracy(real: Column, pred: Column) -> Column:
    """Mean recall over the labels that occur among the actual values."""
    seen = {k: (F.count_if(real == k) > 0).cast("double") for k in (0, 1)}
    recall = _recalls(real, pred)
    return F.try_divide(recall[0] * seen[0] + recall[1] * seen[1], seen[0] + seen[1])


def macro_recall(real: Column, pred: Column) -> Column:
    """Mean recall over the labels that occur among actual or predicted values."""
    seen = {k: (F.count_if((real == k) | (pred == k)) > 0).cast("double") for k in (0, 1)}
    recall = _recalls(real, pred)
    return F.try_divide(recall[0] * seen[0] + recall[1] * seen[1], seen[0] + seen[1])


REGISTRY: dict[str, dict[str, Metric]] = {
    "regression": {"mape": mape, "mse": mse, "rmse": rmse, "r2": r2},
    "classification": {
        "acc": accuracy,
        "b_acc": balanced_accuracy,
        "f1": f1,
        "precision": precision,
        "recall": macro_recall,
    },
}

# Metrics recorded for every trained model and split.
TRAINING: dict[str, Metric] = {"mse": mse, "mae": mae, "rmse": rmse, "r2": r2, "mape_pct": mape_pct}
