"""Bar panels and metric inputs derived from the generic test tables (no bar table is supplied)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.sources.bars import bars_from_ticks
from barline.sources.scratch import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line_order() -> Column:
    """Order key, line number and price in cents as one number: total order of the lines of a day."""
    line = F.col("l_orderkey").cast("decimal(20,0)") * 100 + F.col("l_linenumber")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return (line * F.lit(10**12).cast("decimal(13,0)") + cents).cast("decimal(38,0)")


def _line_bars(spark: SparkSession, sf_dir: str, symbol: str) -> DataFrame:
    return bars_from_ticks(
        table(spark, sf_dir, "lineitem"), F.col(symbol), F.col("l_shipdate"),
        F.col("l_extendedprice"), F.col("l_quantity"), _line_order(),
    )


def bars_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few long series: one per return flag. The bars are tiny beside the lines and most queries read them more than
    once (row counts, then windows), so they are staged: the lines are scanned once."""
    return stage(_line_bars(spark, sf_dir, "l_returnflag"), "bars-flag")


def bars_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many series: one per supplier. Staged like the flag bars: row counts and windows read it, the lines are scanned once."""
    return stage(_line_bars(spark, sf_dir, "l_suppkey"), "bars-supp")


def bars_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short series: one per event type, 30 days."""
    return bars_from_ticks(
        table(spark, sf_dir, "events"), F.col("event_type"), F.col("ts"),
        F.col("value"), F.lit(1.0), F.col("event_id"),
    )
