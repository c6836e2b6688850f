"""Bars: reading files, normalising columns, building bars from ticks.

A bar panel has the columns symbol, date, open, high, low, close, volume, market_cap and is unique on
(symbol, date). The date is a calendar day, so one symbol holds at most one row per day however large the
source is; every builder here enforces that with an aggregate that combines before its shuffle.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.columns import col, first_token, nan_to_null
from barline.sources.scratch import stage

RAW_SCHEMA = T.StructType([
    T.StructField("SNo", T.IntegerType()),
    T.StructField("Name", T.StringType()),
    T.StructField("Symbol", T.StringType()),
    T.StructField("Date", T.TimestampNTZType()),
    T.StructField("High", T.DoubleType()),
    T.StructField("Low", T.DoubleType()),
    T.StructField("Open", T.DoubleType()),
    T.StructField("Close", T.DoubleType()),
    T.StructField("Volume", T.DoubleType()),
    T.StructField("Marketcap", T.DoubleType()),
])

BAR_COLUMNS = ["symbol", "date", "open", "high", "low", "close", "volume", "market_cap"]
PRICES = ["open", "high", "low", "close"]
RANK = "_rank"  # of a raw row: which of two rows of a day was read last


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Every bar CSV under `path` in one scan, columns by position, dataset = file stem."""
    return (
        spark.read.schema(RAW_SCHEMA).option("header", True).option("enforceSchema", False)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
        .withColumn("dataset", first_token(F.col("_metadata.file_name")))
    )


def read_text_bars(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Bar CSVs with every field as text, for validation of types."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return (
        spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
        .withColumn("dataset", first_token(F.col("_metadata.file_name")))
    )


@dataclass
class RawFiles:
    """Rows of files with different headers: every field as text, columns united by plain name, `dataset` and `_rank` (rises inside a file) of each row;
    headers: dataset and the columns (plain names) that its files have. Spark doesn't list files of 0 bytes: a list of expected datasets finds those."""

    rows: DataFrame
    headers: DataFrame


def plain_name(name: str) -> str:
    return name.strip().strip('"').lower().replace(" ", "_")


def dataset_of(path: Column) -> Column:
    """The value of a `dataset=` folder, or else the file name up to its first dot or blank."""
    folder = F.regexp_extract(path, r"/dataset=([^/]+)/", 1)
    return F.when(folder != "", F.url_decode(folder)).otherwise(first_token(F.regexp_extract(F.url_decode(path), r"([^/]+)$", 1)))


@contextmanager
def _listed_by_cores(spark: SparkSession) -> Iterator[None]:
    """Folders are listed in a few tasks a core. By default Spark makes a task of each folder, up to 10,000, which costs more than the listing."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(64, 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at (number of the line, rising inside a part of a file), in_first (in the part at the start of its file), blank, line of every line
    under `path`. Staged: the files are listed and opened once."""
    with _listed_by_cores(spark):
        text = spark.read.option("recursiveFileLookup", True).text(path)
    return stage(text.select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), (F.col("_metadata.file_block_start") == 0).alias("in_first"),
        (~F.col("value").rlike(r"[^\x00-\x20]")).alias("blank"), F.col("value").alias("line")), "lines")


def headers_of(lines: DataFrame) -> DataFrame:
    """file, at, header: the first line of each file that isn't blank, or an empty one where a file has none. `at` is found without the texts, so that
    the aggregate is of fixed width."""
    firsts = lines.where("in_first").groupBy("file").agg(F.coalesce(F.min(F.when(~F.col("blank"), F.col("at"))), F.min("at")).alias("at"))
    return lines.join(F.broadcast(firsts.select("at")), "at", "left_semi").select(
        "file", "at", F.when(~F.col("blank"), F.col("line")).otherwise("").alias("header"))


def read_by_header(spark: SparkSession, path: str) -> RawFiles:
    """Every CSV file under `path`, whatever its header, from one scan: each line is parsed by the header of its file.

    A file with other columns neither fails the read nor moves values into wrong columns. What the lines are joined with is a row per file, broadcast:
    less than the list of files that the driver holds, as for any read."""
    lines = file_lines(spark, path)
    found = stage(headers_of(lines), "headers")
    known = []
    for layout, (header,) in enumerate(sorted(found.select("header").distinct().toLocalIterator())):
        names: list[str] = []
        for name in map(plain_name, next(csv.reader([header]))):
            name = name or "unnamed"
            names.append(name if name not in names else f"{name}_{len(names) + 1}")
        known.append((header, layout, names))
    columns = spark.createDataFrame(known, "header string, layout int, columns array<string>")
    files = found.join(F.broadcast(columns), "header").withColumn("dataset", dataset_of(F.col("file")))
    headers = files.groupBy("dataset").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("columns")))).alias("columns"))

    fields: dict[str, list[tuple[int, int]]] = {}
    for _, layout, names in known:
        for place, name in enumerate(names):
            fields.setdefault(name, []).append((layout, place))
    fields.pop("dataset", None)
    rows = lines.where("NOT blank").join(F.broadcast(files.select("file", F.col("at").alias("header_at"), "layout", "dataset")), "file").where(
        "at != header_at").select("dataset", "at", "layout", *[
            F.when(F.col("layout") == layout, F.from_csv("line", ", ".join(f"_{i} string" for i in range(len(names))))).alias(f"_fields_{layout}")
            for _, layout, names in known if names])
    return RawFiles(rows.select("dataset", *[
        F.coalesce(*[F.col(f"_fields_{layout}._{place}") for layout, place in places]).alias(name) for name, places in fields.items()],
        F.col("at").alias(RANK)), headers)


def normalise(raw: DataFrame, symbol: str | Column = "dataset", keep: Sequence[str] = ()) -> DataFrame:
    """Raw bars -> panel columns: upper-case symbol, calendar day, NULL for NaN, rows without a price dropped."""
    have = {c.lower().replace(" ", "").replace("_", ""): c for c in raw.columns}
    missing = [c for c in ("date", *PRICES) if c not in have]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")

    def number(name: str) -> Column:
        return nan_to_null(F.col(f"`{have[name]}`").try_cast("double")) if name in have else F.lit(None).cast("double")

    return raw.select(
        F.upper(col(symbol)).alias("symbol"),
        F.col(have["date"]).try_cast("date").alias("date"),
        *[number(c).alias(c) for c in PRICES],
        number("volume").alias("volume"),
        number("marketcap").alias("market_cap"),
        *keep,
    ).dropna(subset=["symbol", "date", *PRICES])


def latest_bars(rows: DataFrame, version: str | Column) -> DataFrame:
    """One row per (symbol, date): the one with the highest version."""
    payload = [c for c in BAR_COLUMNS if c in rows.columns and c not in ("symbol", "date")]
    newest = F.max_by(F.struct(*payload), col(version))
    return rows.groupBy("symbol", "date").agg(newest.alias("bar")).select("symbol", "date", "bar.*")


def bars_from_ticks(
    ticks: DataFrame, symbol: Column, time: Column, price: Column, volume: Column, order: Column
) -> DataFrame:
    """Daily bars from trades. `order` ranks the trades of a day; ties must agree on the price.

    A fixed-width `order` (number, decimal) keeps the aggregate a hash aggregate with map-side combine.
    """
    rows = ticks.select(
        symbol.cast("string").alias("symbol"), F.to_date(time).alias("date"),
        price.alias("price"), volume.alias("size"), order.alias("rank"),
    )
    return rows.groupBy("symbol", "date").agg(
        F.min_by("price", "rank").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "rank").alias("close"),
        F.sum("size").alias("volume"),
    )


def complete_from_files(table: DataFrame, files: DataFrame) -> DataFrame:
    """Stored bars first; symbols the table lacks come from the files."""
    missing = files.join(table.select("symbol").distinct(), "symbol", "left_anti")
    return table.unionByName(missing, allowMissingColumns=True)


def keep_long_series(bars: DataFrame, years: float) -> DataFrame:
    """Keep symbols whose first and last day lie strictly more than 365 * years days apart."""
    span = bars.groupBy("symbol").agg(F.datediff(F.max("date"), F.min("date")).alias("days"))
    return bars.join(span.where(F.col("days") > 365 * years), "symbol", "left_semi")


def bars_between(
    bars: DataFrame, symbol: str, start: str | None = None, end: str | None = None, limit: int | None = None
) -> DataFrame:
    """Bars of one symbol in date order, optionally within [start, end] and cut to the first `limit`."""
    out = bars.where(F.col("symbol") == symbol.upper())
    if start:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("date") <= F.lit(end).cast("date"))
    out = out.orderBy("date")
    return out.limit(limit) if limit else out


def symbols(bars: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct()


def date_ranges(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
