"""A layer of window expressions over one spec, each computed once.

The optimizer does not merge equal window expressions, so indicators ask a layer for what they need and get a
plain column back; two indicators that need the same rolling mean share it. All expressions of a layer run in
one Window node, and all frames of equal bounds in one pass over the frame. Expressions are SQL text, which
builds a plan of a hundred columns many times faster than chained Column calls.

A frame costs its width for every row, so whether it is full is read off one running value per column: the row of
its last NULL. Rows are numbered by `seg_row` (see layout).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERIES = "PARTITION BY symbol, segment ORDER BY date"
SO_FAR = f"{SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
SEGMENT = "PARTITION BY symbol, segment"

ROLLING = {"avg": "avg", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum", "n": "count"}


class WindowLayer:
    def __init__(self, series: str = SERIES, below: WindowLayer | None = None):
        """`below` is the layer whose output this one is applied to; what it holds is not computed again."""
        self.series = series
        self.columns: dict[str, str] = {}
        self.known: set[str] = below.known | set(below.columns) if below else set()

    def add(self, name: str, expression: str) -> Column:
        if name not in self.known:
            self.columns.setdefault(name, expression)
        return F.col(name)

    def rolling(self, c: str, n: int, kind: str) -> str:
        name = f"_{kind}_{c}_{n}"
        frame = f"{self.series} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
        self.add(name, f"{ROLLING[kind]}(`{c}`) OVER ({frame})")
        return name

    def last_null(self, c: str) -> str:
        """Number of the last row so far without a value, 0 if there is none."""
        name = f"_last_null_{c}"
        frame = f"{self.series} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
        self.add(name, f"max(CASE WHEN `{c}` IS NULL THEN seg_row ELSE 0 END) OVER ({frame})")
        return name

    def full(self, c: str, n: int, kind: str) -> Column:
        """Rolling aggregate over the last n rows, NULL until the frame holds n non-null values.

        An aggregate of a full frame is never NULL, a spread from two values on. The coalesce tells the optimizer,
        which then drops frames of which only the NULLs are asked for.
        """
        value = f"`{self.rolling(c, n, kind)}`"
        if kind != "std" or n > 1:
            value = f"coalesce({value}, 0)"
        return F.expr(f"CASE WHEN seg_row - `{self.last_null(c)}` >= {n} THEN {value} END")

    def lag(self, c: str, k: int) -> Column:
        return self.add(f"_lag_{c}_{k}", f"lag(`{c}`, {k}) OVER ({self.series})")

    def lead(self, c: str, k: int) -> Column:
        return self.add(f"_lead_{c}_{k}", f"lead(`{c}`, {k}) OVER ({self.series})")

    def row(self) -> Column:
        return self.add("_row", f"row_number() OVER ({self.series})")

    def apply(self, df: DataFrame, derived: dict[str, Column]) -> DataFrame:
        windows = df.selectExpr("*", *[f"{e} AS `{name}`" for name, e in self.columns.items()])
        return windows.withColumns(derived)
