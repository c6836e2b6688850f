"""Exact quantiles of groups of any size.

Groups of at most SORTED_AT_ONCE rows cross one shuffle and are sorted by one task each. `percentile` and sorting keep a group in one task's memory,
which is fine for these but not for raw input, where one source may hold a third of all rows: larger groups go by radix selection. Their values become
64-bit numbers of the same order, and each is counted once with its frequency, whatever the number of fractions. Then, 16 bits a pass from the
top, counts by cell tell which cell holds a wanted place; only cells that hold one go on. After four passes a cell is a value. A cell's place among
others of its prefix is known from at most 65,536 counts, so no task ranks the values of a large group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.sources.scratch import stage

BITS = 16
#: Rows of a group that one task may sort.
SORTED_AT_ONCE = 65_536


def by_size(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups that one task may sort, and rows of larger groups (None: there are none). Rows without a key are in no group."""
    df = df.where(F.col(key).isNotNull())
    large = stage(df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > SORTED_AT_ONCE).select(key), "large-groups")
    if large.isEmpty():
        return df, None
    return df.join(large, key, "left_anti"), df.join(large, key, "left_semi")


def known_values(column: pa.ChunkedArray) -> np.ndarray:
    """Values in order, NULLs skipped; -0.0 counts as 0.0."""
    return np.sort(column.drop_null().to_numpy() + 0.0)


def at_fractions(ordered: np.ndarray, fractions: np.ndarray) -> np.ndarray:
    """Quantiles of sorted values with linear interpolation between neighbours."""
    place = fractions * (len(ordered) - 1)
    low, high = (ordered[side(place).astype(np.int64)] for side in (np.floor, np.ceil))
    with np.errstate(invalid="ignore"):
        return low + (high - low) * (place - np.floor(place))


def _ordered(values: np.ndarray) -> np.ndarray:
    """64-bit numbers in the order of the doubles; -0.0 counts as 0.0."""
    raw = (values + 0.0).view(np.int64)
    return np.where(raw < 0, raw ^ np.int64(2**63 - 1), raw)


def order_code() -> Column:
    @F.pandas_udf("long")
    def code(values: pd.Series) -> pd.Series:
        return pd.Series(_ordered(values.to_numpy(np.float64)))

    return code("value")


def value_of_code() -> Column:
    @F.pandas_udf("double")
    def value(codes: pd.Series) -> pd.Series:
        raw = codes.to_numpy(np.int64)
        return pd.Series(np.where(raw < 0, raw ^ np.int64(2**63 - 1), raw).view(np.float64))

    return value("cell")


def value_counts(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, column, value, held): how often each value stands in a column, NULLs skipped."""
    values = df.select(
        key, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])),
    ).where(F.col("value").isNotNull())
    return values.groupBy(key, "column", "value").agg(F.count("*").alias("held"))


def exact_quantiles(df: DataFrame, key: str, columns: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """(key, column, fraction, quantile) with linear interpolation between neighbours, NULLs skipped. Reads df twice: group sizes first."""
    asked = np.array(fractions, float)

    def sort(own: pa.Table) -> pa.Table:
        found = {c: known_values(own.column(c)) for c in columns}
        found = {c: at_fractions(v, asked) for c, v in found.items() if len(v)}
        names, size = np.repeat(list(found), len(asked)), len(found) * len(asked)
        return pa.table({
            key: own.column(key).slice(0, 1).take(pa.array(np.zeros(size, np.int64))), "column": pa.array(names.tolist(), pa.string()),
            "fraction": np.tile(asked, len(found)), "quantile": np.concatenate([np.empty(0), *found.values()])})

    few, many = by_size(df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]), key)
    schema = T.StructType([few.schema[key], *[T.StructField(n, t) for n, t in (
        ("column", T.StringType()), ("fraction", T.DoubleType()), ("quantile", T.DoubleType()))]])
    out = few.groupBy(key).applyInArrow(sort, schema)
    return out if many is None else out.unionByName(quantiles_of_counts(value_counts(many, key, columns), key, fractions))


def quantiles_of_counts(counts: DataFrame, key: str, fractions: Sequence[float]) -> DataFrame:
    """As exact_quantiles, from key, column, value, held."""
    group = [key, "column"]
    codes = stage(counts.select(*group, order_code().alias("code"), "held"), "codes")
    place = F.col("fraction") * (F.col("n") - 1)
    asked = codes.groupBy(*group).agg(F.sum("held").alias("n")).withColumn(
        "fraction", F.explode(F.array(*[F.lit(float(p)) for p in fractions]))).withColumn("place", place)
    asked = stage(asked, "places")
    # a place is a rank from 0; `before` counts what lies below the prefix that holds it
    wanted = asked.select(*group, F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank")).distinct()
    wanted = wanted.withColumns({"prefix": F.lit(0).cast("long"), "before": F.lit(0).cast("long")})
    for done in range(0, 64, BITS):
        shift = 64 - BITS - done
        prefix = F.shiftright("code", shift + BITS) if done else F.lit(0).cast("long")
        codes_ = codes.withColumn("prefix", prefix).join(wanted.select(*group, "prefix").distinct(), [*group, "prefix"], "left_semi")
        cells = codes_.groupBy(*group, "prefix", F.shiftright("code", shift).alias("cell")).agg(F.sum("held").alias("held"))
        upto = F.sum("held").over(Window.partitionBy(*group, "prefix").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        cells = cells.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("held"))
        holds = (F.col("rank") - F.col("before") >= F.col("from")) & (F.col("rank") - F.col("before") < F.col("upto"))
        wanted = stage(wanted.join(cells, [*group, "prefix"]).where(holds).select(
            *group, "rank", F.col("cell").alias("prefix"), (F.col("before") + F.col("from")).alias("before")), "wanted")
    found = wanted.withColumnRenamed("prefix", "cell").select(*group, "rank", value_of_code().alias("value"))
    low, high = (found.select(*group, F.col("rank").alias(f"{side}_rank"), F.col("value").alias(side)) for side in ("low", "high"))
    both = asked.withColumns({"low_rank": F.floor("place"), "high_rank": F.ceil("place")}).join(low, [*group, "low_rank"]).join(high, [*group, "high_rank"])
    share = F.col("place") - F.floor("place")
    return both.select(*group, "fraction", (F.col("low") + (F.col("high") - F.col("low")) * share).alias("quantile"))
