"""Splits in time order, by position in the series. Input frames carry `pos` (1-based) and `n` per symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")

# Share of rows per split when none, or an impossible set, is given.
DEFAULT_RATIOS = {"train": 0.6, "validation": 0.2, "test": 0.2}


def _whole(rows: Column, share: float) -> Column:
    """Rows times share, cut to a whole number, in double arithmetic."""
    return F.floor(rows.cast("double") * F.lit(float(share)))


def split_by_fraction(frame: DataFrame, test_size: float = 0.2, validation_size: float = 0.2) -> DataFrame:
    """Last part test, the part before it val (a share of what test leaves), the rest train."""
    test = _whole(F.col("n"), test_size)
    val = _whole(F.col("n") - test, validation_size)
    return frame.withColumn(
        "split",
        F.when(F.col("pos") > F.col("n") - test, "test")
        .when(F.col("pos") > F.col("n") - test - val, "val")
        .otherwise("train"),
    )


def split_by_date(frame: DataFrame, split_date: str, validation_size: float = 0.2) -> DataFrame:
    """test from `split_date` on; of the rows before it the last part is val."""
    day = F.lit(split_date).cast("date")
    before = frame.groupBy("symbol").agg(F.count_if(F.col("date") < day).alias("before"))
    cut = F.floor(F.col("before").cast("double") * F.lit(1 - validation_size))
    return (
        frame.join(before, "symbol")
        .withColumn(
            "split",
            F.when(F.col("date") >= day, "test").when(F.col("pos") > cut, "val").otherwise("train"),
        )
        .drop("before")
    )


def split_ratios(train: float, validation: float, test: float) -> dict[str, float]:
    """Percentages to shares: as given up to 100 in total, otherwise the default."""
    if train + validation + test > 100:
        return dict(DEFAULT_RATIOS)
    return {"train": train / 100, "validation": validation / 100, "test": test / 100}


def split_by_ratio(frame: DataFrame, ratios: dict[str, float] | None = None) -> DataFrame:
    """Cut at two cumulative shares; whatever the shares leave over goes to test. Adds both cuts."""
    shares = ratios or DEFAULT_RATIOS
    train_end = _whole(F.col("n"), shares["train"])
    val_end = _whole(F.col("n"), shares["train"] + shares["validation"])
    return frame.withColumns({"train_end": train_end, "val_end": val_end}).withColumn(
        "split",
        F.when(F.col("pos") <= F.col("train_end"), "train")
        .when(F.col("pos") <= F.col("val_end"), "val")
        .otherwise("test"),
    )


def split_at_random(
    frame: DataFrame, test_size: float = 0.2, validation_size: float | None = None, seed: int = 42
) -> DataFrame:
    """Exact-size random split by the rank of a seeded hash; sizes are rounded up.

    With `validation_size` a second draw of that share is taken from the rows test leaves. Ranks come from counts per hash
    slice plus a rank inside the slice, so no symbol is ranked in one task.
    """
    drawn = frame.withColumn("draw", F.xxhash64("symbol", "date", F.lit(seed)))
    drawn = drawn.withColumn("slice", F.shiftright("draw", 58))
    slices = drawn.groupBy("symbol", "slice").agg(F.count("*").alias("held"))
    before = F.sum("held").over(
        Window.partitionBy("symbol").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    ) - F.col("held")
    slices = slices.select("symbol", "slice", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("symbol", "slice").orderBy("draw", "date"))
    ranked = drawn.join(slices, ["symbol", "slice"]).withColumn("rank", F.col("before") + within)
    n = F.col("n").cast("double")
    test = F.ceil(n * F.lit(test_size))
    label = F.when(F.col("rank") <= test, "test")
    if validation_size:
        val = F.ceil((n - test) * F.lit(validation_size))
        label = label.when(F.col("rank") <= test + val, "val")
    return ranked.withColumn("split", label.otherwise("train")).drop("draw", "slice", "before", "rank")


def split_three_at_random(frame: DataFrame, ratios: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    shares = ratios or DEFAULT_RATIOS
    rest = shares["train"] + shares["validation"]
    return split_at_random(frame, shares["test"], shares["validation"] / rest, seed)


def expanding_folds(frame: DataFrame, folds: int = 5) -> DataFrame:
    """One copy of a row per fold it takes part in, with `fold` (0-based) and `role` train or test.

    Fold i tests the i-th of `folds` equal blocks at the end of the series and trains on everything before it.
    """
    block = F.floor(F.col("n") / (folds + 1))
    start = F.col("n") - (F.lit(folds) - F.col("fold")) * block
    return (
        frame.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
        .withColumn("test_start", start)
        .where(F.col("pos") <= F.col("test_start") + block)
        .withColumn("role", F.when(F.col("pos") > F.col("test_start"), "test").otherwise("train"))
        .drop("test_start")
    )
