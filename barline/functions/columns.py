"""Small column expressions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """A missing value is NULL everywhere in the library, never NaN."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, NULL on a zero denominator (ANSI mode would raise)."""
    return F.try_divide(col(num), col(den))


def first_token(path: str | Column) -> Column:
    """File stem: the last path part without its extension."""
    return F.regexp_extract(col(path), r"([^/]+?)(?:\.[^./]*)?$", 1)


def last_token(name: str | Column, sep: str = "_") -> Column:
    return F.element_at(F.split(col(name), sep), -1)


def days_between(start: str | Column, end: str | Column) -> Column:
    return F.datediff(col(end), col(start))


def ema_lookback(span: int) -> int:
    """Rows after which an exponential weight has fallen below 1e-17 of the newest one."""
    decay = 1.0 - 2.0 / (span + 1.0)
    return 0 if decay <= 0 else math.ceil(math.log(1e-17) / math.log(decay))
