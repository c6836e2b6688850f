"""Spread ordered series over the cluster without a task per series.

A window over a whole series puts that series into one task. Every operator here looks a bounded number of
rows back (or ahead), so a series is cut into segments and each segment gets a copy of the neighbouring rows
it needs. Windows are then partitioned by (symbol, segment): a symbol that holds a third of the panel is as
parallel as the rest. The cut is planned on row counts per calendar chunk, a table 1/64 the size of the panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK_SHIFT = 6  # a chunk is 2**6 = 64 calendar days
CHUNK_ROWS = 1 << CHUNK_SHIFT
SEGMENT_ROWS = 1920


def series() -> WindowSpec:
    return Window.partitionBy("symbol", "segment").orderBy("date")


def so_far() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def chunk_of(date: str | Column = "date") -> Column:
    return F.shiftright(F.unix_date(date), CHUNK_SHIFT)


def rows_per_segment(back: int = 0, ahead: int = 0) -> int:
    return max(SEGMENT_ROWS, back + CHUNK_ROWS, ahead + CHUNK_ROWS)


def widest_segment(back: int = 0, ahead: int = 0) -> int:
    """Upper bound of the rows a window partition holds, copies included."""
    return rows_per_segment(back, ahead) + back + ahead + 3 * CHUNK_ROWS


def segment_plan(bars: DataFrame, back: int = 0, ahead: int = 0) -> DataFrame:
    """(symbol, chunk) -> rows before it, rows of the symbol, home segment, segments that receive its rows."""
    size = rows_per_segment(back, ahead)
    chunks = bars.groupBy("symbol", chunk_of().alias("chunk")).agg(F.count("*").alias("held"))
    symbol = Window.partitionBy("symbol")
    chunks = chunks.withColumns({
        "n": F.sum("held").over(symbol),
        "before": F.sum("held").over(symbol.orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0))
        - F.col("held"),
    })
    chunks = chunks.withColumn("home", F.floor(F.col("before") / size))
    later = symbol.orderBy(F.desc("home")).rangeBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumns({
        "home_start": F.min("before").over(Window.partitionBy("symbol", "home")),
        "next_start": F.min("before").over(later),
    })
    end = F.col("before") + F.col("held")
    targets = F.array(
        F.col("home"),
        F.when(F.col("next_start") - end < back, F.col("home") + 1),
        F.when((F.col("home") > 0) & (F.col("before") - F.col("home_start") < ahead), F.col("home") - 1),
    )
    return chunks.select("symbol", "chunk", "n", "before", "home", F.array_compact(targets).alias("targets"))


def lay_out(bars: DataFrame, back: int = 0, ahead: int = 0) -> DataFrame:
    """Add `segment`, `core` (False on copies), `n` (rows of the symbol), `pos` (1-based place in the series) and
    `seg_row` (the same in the segment, copies included).

    `bars` must be unique on (symbol, date): that bounds a chunk at 64 rows. `back` and `ahead` are the numbers
    of neighbouring rows the caller's windows reach for; `drop_copies` removes the copies afterwards.
    """
    planned = (
        bars.withColumn("chunk", chunk_of())
        .join(segment_plan(bars, back, ahead), ["symbol", "chunk"])
        .withColumn("segment", F.explode("targets"))
    )
    numbered = planned.withColumns({"seg_row": F.row_number().over(series()), "first_before": F.first("before").over(so_far())})
    return numbered.withColumns(
        {"pos": F.col("first_before") + F.col("seg_row"), "core": F.col("segment") == F.col("home")}
    ).drop("chunk", "before", "home", "targets", "first_before")


def drop_copies(df: DataFrame) -> DataFrame:
    return df.where("core").drop("core", "seg_row")


def positions(bars: DataFrame) -> DataFrame:
    """Bars with `pos` and `n` only."""
    return lay_out(bars).drop("segment", "core", "seg_row")
