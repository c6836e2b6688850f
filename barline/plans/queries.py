"""Registered queries: one per operator, run over whole tables of the given folder.

Keys are <inventory id>_<short name>. Doubles are rounded (prices to 3 digits, ratios to 6) so that results can
be compared by value with another engine.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions.columns import days_between, first_token, last_token, ratio
from barline.functions.windows import WindowLayer
from barline.operators import evaluate, forecast, indicators as ind, lasso, models, panel, prepare, search, splits, validate
from barline.operators.features import FeatureSpec, engineer_features, null_budget, supervised_frame, training_rows
from barline.operators.layout import drop_copies, lay_out, positions
from barline.operators.quantiles import exact_quantiles
from barline.plans import pipeline
from barline.sources import bars as B
from barline.sources import derived, lake, relations, runs, sinks, store
from barline.sources.derived import bars_events, bars_flag, bars_supp, table
from barline.sources.scratch import MANY_FILES, fresh_path, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

T0 = datetime(2024, 1, 1)
T1 = datetime(2024, 1, 2)

PRICE_LEVEL = (
    "MA_", "EMA_", "MACD", "BB_upper", "BB_middle", "BB_lower", "BB_width", "close_", "open", "high", "low", "close",
    "target", "prediction", "predicted_value", "actual_value", "confidence_", "median", "mean", "std", "quantile",
)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def digits_of(name: str) -> int:
    if name.endswith("_ratio"):
        return 6
    if "mse" in name or name == "price_volume":
        return 2
    if name.startswith("MA_") or name == "BB_middle":
        return 4  # a mean of 20 cent prices is a multiple of 0.0005
    if name == "quantile":
        return 4
    if name.startswith(("EMA_", "MACD")):
        return 5
    return 3 if name.startswith(PRICE_LEVEL) else 6


def tidy(df: DataFrame, **digits: int) -> DataFrame:
    doubles = [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, digits.get(c, digits_of(c))) + F.lit(0.0) for c in doubles})


def with_layer(bars: DataFrame, back: int, build: Callable[[WindowLayer], dict[str, Column]], ahead: int = 0) -> DataFrame:
    """Keys, close and the columns of one window layer."""
    layer = WindowLayer()
    columns = build(layer)
    out = drop_copies(layer.apply(lay_out(bars, back, ahead), columns))
    return tidy(out.select("symbol", "date", *columns))


def feature_columns(spark: SparkSession, sf: str, *names: str, bars=bars_flag) -> DataFrame:
    return tidy(engineer_features(bars(spark, sf)).select("symbol", "date", *names))


# ---- sources and sinks ------------------------------------------------------------------------------------------


def raw_layout(bars: DataFrame) -> DataFrame:
    """Bars in the column layout of a raw file, stamped one second before midnight."""
    return bars.select(
        F.lit(1).alias("SNo"), F.col("symbol").alias("Name"), F.col("symbol").alias("Symbol"),
        F.date_format(F.col("date").cast("timestamp_ntz") + F.expr("INTERVAL 86399 SECONDS"), "yyyy-MM-dd HH:mm:ss").alias("Date"),
        F.col("high").alias("High"), F.col("low").alias("Low"), F.col("open").alias("Open"), F.col("close").alias("Close"),
        F.col("volume").alias("Volume"), F.lit(None).cast("double").alias("Marketcap"),
    )


def raw_files(spark: SparkSession, bars: DataFrame) -> str:
    path = fresh_path(spark, "raw-csv")
    raw_layout(bars).write.option("header", True).csv(path)
    return path


@query
def s1_read_csv(spark, sf):
    raw = B.read_raw(spark, raw_files(spark, bars_flag(spark, sf)))
    return tidy(B.normalise(raw, "Symbol").select("symbol", "date", *B.PRICES, "volume"))


@query
def s2_read_directory(spark, sf):
    raw = B.read_raw(spark, raw_files(spark, bars_supp(spark, sf)))
    return raw.agg(
        F.count("*").alias("rows"), F.count_distinct("Symbol").alias("symbols"),
        (F.count_distinct("dataset") > 0).alias("has_files"),
    )


def files_of_three_layouts(spark: SparkSession, sf: str) -> str:
    """A file per supplier, in three layouts: all columns; an additional note and no volume; no opening price."""
    path, raw = fresh_path(spark, "raw-layouts"), raw_layout(bars_supp(spark, sf)).withColumn("dataset", F.col("Symbol"))
    kind = F.col("Symbol").cast("int") % 3
    for k, part in enumerate((raw, raw.drop("Volume", "Marketcap").withColumn("Note", F.lit("x")), raw.drop("Open"))):
        part.where(kind == k).repartition("dataset").write.options(**MANY_FILES).option("header", True).partitionBy("dataset").csv(f"{path}/layout-{k}")
    return path


@query
def s2_files_of_three_headers(spark, sf):
    """One directory, three headers: rows and filled fields of each dataset."""
    files = B.read_by_header(spark, files_of_three_layouts(spark, sf))
    return files.rows.groupBy("dataset").agg(
        F.count("*").alias("rows"), *[F.count(c).alias(f"n_{c}") for c in ("date", "open", "close", "volume", "note")]).join(
        files.headers.select("dataset", F.array_join("columns", ",").alias("columns")), "dataset")


@query
def v2_columns_of_each_file(spark, sf):
    """Missing and unexpected columns of each dataset."""
    files = B.read_by_header(spark, files_of_three_layouts(spark, sf))
    found = validate.findings(files.rows, headers=files.headers, checks=["columns"])
    return found.select("dataset", "column", "severity", "message")


@query
def s11_import_of_three_headers(spark, sf):
    """Files without an opening price are failed jobs; the others come in."""
    files = B.read_by_header(spark, files_of_three_layouts(spark, sf))
    target = bar_table(spark, bars_supp(spark, sf).where("date < '1996-01-01'"))
    report = pipeline.import_bars(files.rows, target, T1, headers=files.headers)
    stored = target.read().groupBy("symbol").agg(F.count("*").alias("stored"))
    return report.jobs.select("symbol", "status", "records_processed").join(stored, "symbol", "left")


def bar_table(spark: SparkSession, bars: DataFrame) -> store.BarTable:
    return store.BarTable(spark, fresh_path(spark, "bars"), buckets=8).create(bars, T0)


@query
def s3_scan_symbol(spark, sf):
    return tidy(bar_table(spark, bars_flag(spark, sf)).scan("n", "1996-01-01", "1999-12-31", 500).drop("market_cap"))


@query
def s4_source_fallback(spark, sf):
    bars = bars_flag(spark, sf)
    stored = bars.where(F.col("symbol") != "R")
    files = bars.withColumn("close", F.col("close") + 1)
    return tidy(B.complete_from_files(stored, files).select("symbol", "date", "close"))


@query
def s5_symbols(spark, sf):
    return B.symbols(bars_supp(spark, sf))


@query
def s6_date_range(spark, sf):
    return B.date_ranges(bars_supp(spark, sf))


def upsert_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Stored bars up to 1999 and incoming bars from 1998 with changed closes."""
    bars = bars_flag(spark, sf)
    return bars.where(F.col("date") < "2000-01-01"), bars.where(F.col("date") >= "1998-01-01").withColumn("close", F.col("close") * 2)


@query
def s7_upsert(spark, sf):
    old, new = upsert_parts(spark, sf)
    target = bar_table(spark, old)
    target.upsert(new, T1)
    return tidy(target.read().select("symbol", "date", "close", (F.col("created_at") < F.col("updated_at")).alias("updated")))


@query
def s7_inserted(spark, sf):
    old, new = upsert_parts(spark, sf)
    return store.new_keys(old, new).agg(F.count("*").alias("inserted"))


@query
def s8_delete_symbol(spark, sf):
    target = bar_table(spark, bars_flag(spark, sf))
    gone = target.delete("A")
    return target.read().groupBy("symbol").agg(F.count("*").alias("rows"), F.lit(gone).cast("bigint").alias("deleted"))


@query
def s9_sources(spark, sf):
    known = table(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit("known").alias("description"))
    extra = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit("new").alias("description"))
    return store.add_sources(known, known.withColumn("description", F.lit("again")).unionByName(extra))


def supplier_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """Import outcome per supplier: every seventh one has an error."""
    rows = bars_supp(spark, sf).groupBy("symbol").agg(F.count("*").alias("records_processed"))
    none = F.array().cast("array<string>")
    bad = F.col("symbol").cast("int") % 7 == 0
    return rows.select(
        "symbol", F.when(bad, F.array(F.lit("negative close"))).otherwise(none).alias("errors"), none.alias("warnings"),
        "records_processed", (F.col("records_processed") - 3).alias("records_inserted"), F.lit(2).cast("bigint").alias("records_skipped"),
    )


@query
def s10_import_jobs(spark, sf):
    outcome = supplier_outcome(spark, sf)
    started = store.jobs_started(outcome.select("symbol"), "csv_import", F.lit(T0))
    events = started.unionByName(store.jobs_finished(started, outcome, F.lit(T1)))
    return store.current_jobs(events).select(
        "source", "symbol", "status", "records_processed", "records_inserted", "records_updated", "records_skipped", "error_message",
        "validation_errors"
    )


def supplier_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Raw rows per supplier with faults: every seventh supplier has negative closes in 1997. Columns of the staged bars, so not staged again."""
    bars = bars_supp(spark, sf).withColumnRenamed("symbol", "dataset")
    bad = (F.col("dataset").cast("int") % 7 == 0) & (F.year("date") == 1997)
    return bars.withColumn("close", F.when(bad, -F.col("close")).otherwise(F.col("close")))


@query
def s11_import_files(spark, sf):
    """Raw rows of which some have no open, into a table that holds their first years."""
    raw = supplier_raw(spark, sf)
    early = B.normalise(raw.where(F.col("date") < "1996-01-01"))
    gaps = raw.withColumn("open", F.when(F.dayofyear("date") % 40 != 0, F.col("open")))
    jobs = pipeline.import_bars(gaps, bar_table(spark, early), T1).jobs
    return jobs.select(
        "symbol", "status", *[f"records_{c}" for c in ("processed", "inserted", "updated", "skipped")], "data_start_date", "data_end_date")


@query
def s12_filter_length(spark, sf):
    """Long series by supplier beside the short ones by event type; the latter go."""
    kept = B.keep_long_series(bars_supp(spark, sf).unionByName(bars_events(spark, sf)), 5)
    return tidy(kept.select("symbol", "date", *B.PRICES))


@query
def s13_available_datasets(spark, sf):
    return validate.structurally_valid(supplier_raw(spark, sf))


@query
def s14_load_validated(spark, sf):
    gated = validate.quality_gate(supplier_raw(spark, sf), 2)
    return tidy(B.normalise(gated).select("symbol", "date", *B.PRICES))


@query
def s15_ingest_zone(spark, sf):
    root = fresh_path(spark, "lake")
    bars = bars_flag(spark, sf)
    paths = [lake.ingest(bars, root, zone, "symbol", folder) for zone, folder in (("raw", None), ("processed", "transformed"))]
    parts = [spark.read.parquet(p).withColumn("zone", F.lit(z)) for p, z in zip(paths, ("raw", "processed"))]
    return parts[0].unionByName(parts[1]).groupBy("zone", "symbol").agg(F.count("*").alias("rows"))


@query
def s16_archive(spark, sf):
    root = fresh_path(spark, "lake")
    path = lake.archive(bars_events(spark, sf), root, "bars_events", T0)
    kept = spark.read.option("basePath", path.rsplit("/", 1)[0]).parquet(path)
    return tidy(kept.select("symbol", "date", "close", F.col("archived_at").cast("string").alias("archived_at")))


# ---- projections, filters, scalar functions ----------------------------------------------------------------------


@query
def p1_select_drop(spark, sf):
    return bars_flag(spark, sf).drop("volume").withColumnRenamed("close", "Close").select("symbol", "date", "Close")


@query
def p2_lenient_cast(spark, sf):
    props = table(spark, sf, "events").select(F.get_json_object("props", "$.k").alias("text"), "event_type")
    text = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("text"))
    cast = props.withColumn("text", text).withColumn("number", F.col("text").try_cast("double"))
    return tidy(cast.groupBy("event_type").agg(
        F.count("number").alias("castable"),
        F.count_if(F.col("text").isNotNull() & F.col("number").isNull()).alias("uncastable"),
        F.sum("number").alias("total"),
    ))


@query
def p3_range_filter(spark, sf):
    keep = (F.col("symbol") == "R") & F.col("date").between(F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date"))
    return tidy(bars_flag(spark, sf).where(keep))


@query
def p4_drop_null_target(spark, sf):
    f = engineer_features(bars_flag(spark, sf), FeatureSpec(horizon=5))
    return tidy(f.where(F.col("target").isNotNull()).select("symbol", "date", "target"))


@query
def p5_drop_empty_rows(spark, sf):
    names = ["returns", "RSI", "MA_50"]
    f = engineer_features(bars_flag(spark, sf)).select("symbol", "date", *names)
    return tidy(f.dropna(how="all", subset=names))


@query
def p6_short_series(spark, sf):
    rows = training_rows(engineer_features(bars_events(spark, sf)))
    return tidy(rows.select("symbol", "date", "returns", "MA_10", "RSI", "close_lag_7", "target", "pos", "n"))


@query
def p7_fill_after_scaling(spark, sf):
    rows = splits.split_by_fraction(training_rows(engineer_features(bars_flag(spark, sf))))
    out = prepare.scale(rows, ["MA_20_ratio", "returns"])
    return tidy(out.select("symbol", "date", "split", "MA_20_ratio", "returns"))


@query
def p8_coalesce_volume(spark, sf):
    raw = bars_events(spark, sf).withColumn("volume", F.when(F.dayofmonth("date") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("volume")))
    return tidy(B.normalise(raw, "symbol").select("symbol", "date", "volume", "market_cap"))


@query
def p9_supervised(spark, sf):
    return tidy(supervised_frame(bars_flag(spark, sf), horizon=3))


@query
def f1_upper(spark, sf):
    return bars_events(spark, sf).select(F.upper("symbol").alias("symbol"), "date")


@query
def f2_file_names(spark, sf):
    name = F.concat(F.lit("lake/series_"), F.col("n_name"), F.lit(".csv"))
    stem = first_token(name)
    return table(spark, sf, "nation").select("n_nationkey", stem.alias("stem"), last_token(stem).alias("token"))


@query
def f3_key_prefix(spark, sf):
    return table(spark, sf, "nation").select(runs.key_of(F.lit("exp"), "n_name", F.col("n_regionkey").cast("string")).alias("key"))


@query
def f4_timestamps(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    parsed = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf, "events").select("event_id", text.alias("text"), F.date_format(parsed, "yyyy-MM-dd").alias("day"))


@query
def f5_date_arithmetic(spark, sf):
    ends = bars_supp(spark, sf).groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return tidy(ends.select(
        "symbol", F.date_add("b", 1).alias("next_date"), days_between("a", "b").alias("days"),
        (days_between("a", "b") / 365.25).alias("years"), (days_between("a", "b") >= 2 * 365).alias("long_enough"),
    ))


@query
def f6_date_spine(spark, sf):
    ends = bars_supp(spark, sf).groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return forecast.date_spine(ends, F.col("a"), F.col("b"))


@query
def f7_math(spark, sf):
    b = bars_flag(spark, sf)
    return tidy(b.select(
        "symbol", "date", F.ln("close").alias("ln_close"), F.sqrt("volume").alias("root_volume"),
        F.abs(F.col("close") - F.col("open")).alias("move"), ratio(F.col("close") * 100, "open").alias("pct"),
    ), move=3)


@query
def f8_json(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.to_json(F.struct("n_name", "n_regionkey")).alias("json"))


@query
def f9_conditional(spark, sf):
    b = bars_flag(spark, sf)
    return tidy(b.select("symbol", "date", F.when(F.col("close") > F.col("open"), F.col("close") - F.col("open")).otherwise(0.0).alias("open_gain")))


# ---- joins -------------------------------------------------------------------------------------------------------


@query
def j1_aligned_columns(spark, sf):
    return feature_columns(spark, sf, "returns", "MA_5", "RSI", "BB_width", "Stoch_K")


@query
def j2_semi_by_index(spark, sf):
    f = engineer_features(bars_flag(spark, sf)).select("symbol", "date", "MA_5", "target")
    target = f.where(F.col("target").isNotNull()).select("symbol", "date")
    return tidy(f.select("symbol", "date", "MA_5").join(target, ["symbol", "date"], "left_semi"))


@query
def j3_upsert_match(spark, sf):
    old, new = upsert_parts(spark, sf)
    known = new.join(old.select("symbol", "date"), ["symbol", "date"], "left_semi").withColumn("action", F.lit("update"))
    fresh = store.new_keys(old, new).withColumn("action", F.lit("insert"))
    return known.unionByName(fresh).groupBy("symbol", "action").agg(F.count("*").alias("rows"))


@query
def j4_actual_lookup(spark, sf):
    bars = bars_supp(spark, sf)
    return tidy(forecast.with_actuals(bars.select("symbol", "date", F.col("open").alias("predicted_value")), bars, 2))


def whole_spine(bars: DataFrame) -> DataFrame:
    ends = bars.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return forecast.date_spine(ends, F.col("a"), F.date_add("b", 5))


@query
def j5_asof_join(spark, sf):
    bars = bars_supp(spark, sf).select("symbol", "date", "close", "volume")
    return tidy(forecast.asof_before(whole_spine(bars), bars))


@query
def j6_bounded_range_join(spark, sf):
    bars = positions(bars_flag(spark, sf))
    ends = bars.groupBy("symbol").agg(F.max("date").alias("b"))
    spine = forecast.date_spine(ends, F.date_sub("b", 29), F.col("b"))
    rows = forecast.rows_before(spine, bars, 100)
    return tidy(rows.groupBy("symbol", "pred_date").agg(
        F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum("close").alias("close_sum"),
    ))


def metric_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pairs = regression_pairs(spark, sf)
    return pairs.select("dataset", "id", "y_real"), pairs.where(F.col("id") % 7 != 0).select("dataset", "id", "y_pred")


@query
def j7_alignment(spark, sf):
    return evaluate.alignment(*metric_sides(spark, sf))


@query
def j8_symbols_in_both(spark, sf):
    bars = bars_supp(spark, sf)
    modelled = table(spark, sf, "supplier").where(F.col("s_acctbal") > 0).select(F.col("s_suppkey").cast("string").alias("symbol"))
    return B.symbols(bars).join(modelled, "symbol", "left_semi")


@query
def j9_foreign_keys(spark, sf):
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return tidy(
        s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", "n_name").agg(F.count("*").alias("suppliers"), F.sum("s_acctbal").alias("balance")), balance=2,
    )


@query
def j9_references(spark, sf):
    """Import jobs and their sources, predictions with their models and bars, metrics and their models: what is known and what is an orphan."""
    nations = table(spark, sf, "nation")
    supplied = table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    told = forecasts(spark, sf)
    tables = {
        "jobs": supplied.select(F.col("s_suppkey").cast("string").alias("symbol"), F.col("n_name").alias("source")),
        "sources": nations.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name <> 'ASIA'").select(F.col("n_name").alias("name")),
        "models": told.where("split = 'test' AND model <> 'ma_10'").select("symbol", "model"),
        "predictions": told.select("symbol", "model", F.date_add("date", 1).alias("target_date")),
        "metrics": evaluate.training_metrics(told).select("symbol", "model"), "bars": bars_flag(spark, sf)}
    return relations.reference_report(tables)


@query
def j10_apply_statistics(spark, sf):
    bars = bars_supp(spark, sf)
    stats = prepare.scaler_stats(bars, ["close"], "standard")
    return tidy(prepare.apply_scaler(bars, stats, ["close"]).select("symbol", "date", "close"), close=6)


# ---- aggregates --------------------------------------------------------------------------------------------------


def faulty_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Raw rows with planted faults: repeated days, missing, zero and negative prices, swapped extremes, text."""
    b = bars_flag(spark, sf).withColumnRenamed("symbol", "dataset")
    day, month = F.dayofmonth("date"), F.month("date")
    faulty = b.select(
        "dataset", "date",
        F.when((F.col("dataset") == "A") & (day == 13), F.lit(None)).when(day == 29, F.lit("0")).otherwise(F.col("open").cast("string")).alias("open"),
        F.when((F.col("dataset") == "N") & (day == 7), F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        F.col("low"),
        F.when((F.col("dataset") == "R") & (day == 3), F.lit("oops")).when((F.col("dataset") == "N") & (day == 5), F.concat(F.lit("-"), F.col("close").cast("string"))).otherwise(F.col("close").cast("string")).alias("close"),
        F.when(day <= 2, F.lit(None)).otherwise(F.col("volume")).alias("volume"),
        F.lit("x").alias("note"),
    ).where(~((month == 6) & (day > 20)))
    return faulty.unionByName(faulty.where((F.col("dataset") == "N") & (day == 1)))


@query
def a1_row_count(spark, sf):
    raw = faulty_raw(spark, sf)
    return raw.groupBy("dataset").agg(F.count("*").alias("rows"), F.lit(len(raw.columns) - 1).alias("columns"))


@query
def a2_null_counts(spark, sf):
    return tidy(validate.completeness(faulty_raw(spark, sf)).select("dataset", "column", "missing", "pct"))


@query
def a3_conditional_counts(spark, sf):
    return validate.profile(faulty_raw(spark, sf)).select(
        "dataset", *[f"{c}__{k}" for c in validate.PRICES for k in ("negative", "zero")], *validate.STRUCTURE)


@query
def a4_exact_quantiles(spark, sf):
    bars = bars_supp(spark, sf)
    return tidy(exact_quantiles(bars, "symbol", ["open", "close"], [0.01, 0.25, 0.75, 0.99]))


@query
def a5_mean_std_median(spark, sf):
    f = engineer_features(bars_flag(spark, sf))
    return tidy(prepare.outlier_stats(f, SCORED), **{f"{c}__{s}": 2 if c == "price_volume" else 4 for c in SCORED for s in ("mean", "std", "median")})


@query
def a6_spans(spark, sf):
    return tidy(validate.profile(faulty_raw(spark, sf)).select(
        "dataset", "first_date", "last_date", "span_days", (F.col("span_days") / 365.25).alias("span_years")))


@query
def a7_duplicate_dates(spark, sf):
    return validate.profile(faulty_raw(spark, sf)).select("dataset", "duplicates")


@query
def a8_usual_step(spark, sf):
    return validate.usual_step(validate.day_steps(bars_supp(spark, sf).withColumnRenamed("symbol", "dataset")))


@query
def a9_large_gaps(spark, sf):
    return validate.large_gaps(bars_supp(spark, sf).withColumnRenamed("symbol", "dataset"))


def forecasts(spark: SparkSession, sf: str, features: DataFrame | None = None) -> DataFrame:
    """Long predictions of the SQL forecasters (persistence, means, exponential mean) with split and target. Rows are staged:
    weights and forecasts read them."""
    rows = training_rows(engineer_features(bars_flag(spark, sf)) if features is None else features)
    rows = splits.split_by_fraction(rows).select("symbol", "date", "split", "target", *sorted(set(FORECASTERS.values())))
    rows = stage(rows, "forecaster-rows")
    return forecast.model_rows(rows, FORECASTERS, ("symbol", "date", "split", "target"))


FORECASTERS = {"persistence": "close", "ma_5": "MA_5", "ma_10": "MA_10", "ema_12": "EMA_12"}


def regression_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Actual next close against today's close, by split; ids are positions in the series of each symbol."""
    rows = splits.split_by_ratio(supervised_frame(bars_flag(spark, sf).withColumn("today", F.col("close"))))
    return rows.select(
        F.col("split").alias("dataset"), (F.col("pos") * 10 + F.ascii("symbol") % 10).alias("id"),
        F.col("target").alias("y_real"), F.col("today").alias("y_pred"),
    )


def label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    part = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf, "labels").select(
        part.alias("dataset"), F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y_real"), F.col("toxic").cast("double").alias("y_pred"))


@query
def a10_training_metrics(spark, sf):
    return tidy(evaluate.training_metrics(forecasts(spark, sf)), value=2)


@query
def a11_regression_metrics(spark, sf):
    return tidy(evaluate.metric_rows(regression_pairs(spark, sf), ("mape", "mse", "rmse", "r2")), rmse=3)


@query
def a12_classification_metrics(spark, sf):
    return tidy(evaluate.metric_rows(label_pairs(spark, sf), ("acc", "b_acc", "f1", "precision", "recall"), "classification"))


@query
def a13_metric_driver(spark, sf):
    pairs = regression_pairs(spark, sf)
    meta = {"problem_type": "regression", "metrics": ("mape", "r2", "rmse"), "results_file_name": "m",
            "results_structure": "single_row", "comment": "persistence", "save": False}
    out = evaluate.calculate_metrics(pairs.select("dataset", "id", "y_real"), pairs.select("dataset", "id", "y_pred"), meta)
    return tidy(out, rmse_train=3, rmse_val=3, rmse_test=3)


@query
def a14_split_metrics(spark, sf):
    return tidy(evaluate.split_metrics(regression_pairs(spark, sf)))


def fold_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Negative squared error of each forecaster on each expanding-window fold."""
    rows = training_rows(engineer_features(bars_flag(spark, sf)))
    test = splits.expanding_folds(rows, 5).where(F.col("role") == "test")
    long = forecast.model_rows(test, FORECASTERS, ("symbol", "date", "fold", "target"))
    err = F.col("target") - F.col("prediction")
    return long.groupBy("symbol", "model", "fold").agg((-F.avg(err * err)).alias("score"))


@query
def a15_cv_summary(spark, sf):
    return tidy(evaluate.cv_summary(fold_scores(spark, sf)), cv_score_mean=2, cv_score_std=2)


def backtest_rows(spark: SparkSession, sf: str, days: int = 60) -> DataFrame:
    bars = bars_flag(spark, sf)
    f = stage(engineer_features(bars), "features")  # forecasts and backtest read the same frame
    ends = bars.groupBy("symbol").agg(F.max("date").alias("b"))
    spine = forecast.date_spine(ends, F.date_sub("b", days - 1), F.col("b"))
    val = forecasts(spark, sf, f).where(F.col("split") == "val")
    return forecast.backtest(spine, f, bars, FORECASTERS, forecast.ensemble_weights(val))


@query
def a16_prediction_summary(spark, sf):
    return tidy(evaluate.prediction_summary(backtest_rows(spark, sf)), min_prediction=3, max_prediction=3, mean_prediction=3, std_prediction=3, mae=3)


def comparison(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.compare_models(evaluate.training_metrics(forecasts(spark, sf)), fold_scores(spark, sf))


@query
def a17_experiment_overview(spark, sf):
    return tidy(evaluate.experiment_overview(comparison(spark, sf)), avg_test_mae=3)


@query
def a17_model_performance(spark, sf):
    """Test errors and place of every (symbol, model)."""
    return tidy(evaluate.model_performance(comparison(spark, sf)), test_mae=3)


@query
def a18_f_scores(spark, sf):
    rows = splits.split_by_fraction(training_rows(engineer_features(bars_flag(spark, sf))))
    scored = prepare.f_scores(rows.where(F.col("split") == "train").na.fill(0.0, SCORED), SCORED)
    return tidy(scored, score=2)


SCORED = FeatureSpec().names


@query
def a19_dataset_info(spark, sf):
    return tidy(validate.dataset_info(faulty_raw(spark, sf)))


# ---- windows -----------------------------------------------------------------------------------------------------


@query
def w1_moving_averages(spark, sf):
    return with_layer(bars_supp(spark, sf), 50, lambda w: ind.moving_averages(w))


@query
def w2_exponential_averages(spark, sf):
    return feature_columns(spark, sf, "EMA_12", "EMA_12_ratio", "EMA_26", "EMA_26_ratio")


@query
def w3_rsi(spark, sf):
    return feature_columns(spark, sf, "RSI", bars=bars_supp)


@query
def w4_macd(spark, sf):
    return feature_columns(spark, sf, "MACD", "MACD_signal", "MACD_histogram")


@query
def w5_bollinger(spark, sf):
    return with_layer(bars_supp(spark, sf), 20, lambda w: ind.bollinger_bands(w))


@query
def w6_stochastic(spark, sf):
    return feature_columns(spark, sf, "Stoch_K", "Stoch_D", bars=bars_supp)


@query
def w7_returns(spark, sf):
    return with_layer(bars_supp(spark, sf), 1, lambda w: {k: v for k, v in ind.price_moves(w).items() if "returns" in k})


@query
def w8_bar_shape(spark, sf):
    return tidy(bars_supp(spark, sf).select("symbol", "date", *[c.alias(k) for k, c in ind.bar_shape().items()]))


@query
def w9_volume(spark, sf):
    return with_layer(bars_supp(spark, sf), 20, lambda w: ind.volume_features(w))


@query
def w10_lags(spark, sf):
    return feature_columns(
        spark, sf, *[f"{c}_lag_{k}" for k in range(1, 8) for c in ("close", "returns", "volume")])


@query
def w11_rolling_spread(spark, sf):
    return feature_columns(
        spark, sf, *[f"{c}_{n}" for n in (5, 10, 20) for c in ("close_std", "returns_std", "close_min", "close_max")])


@query
def w12_feature_frame(spark, sf):
    return tidy(engineer_features(bars_flag(spark, sf)).drop("segment"))


@query
def w12_short_series(spark, sf):
    return tidy(engineer_features(bars_events(spark, sf)).drop("segment"))


@query
def w12_null_budget(spark, sf):
    return null_budget(engineer_features(bars_supp(spark, sf)))


@query
def w13_forward_target(spark, sf):
    return with_layer(bars_supp(spark, sf), 0, lambda w: {"target": w.lead("close", 3)}, ahead=3)


@query
def w14_split_fraction(spark, sf):
    return splits.split_by_fraction(positions(bars_supp(spark, sf))).select("symbol", "date", "split")


@query
def w15_split_date(spark, sf):
    return splits.split_by_date(positions(bars_supp(spark, sf)), "2000-01-01").select("symbol", "date", "split")


@query
def w16_split_ratio(spark, sf):
    return splits.split_by_ratio(positions(bars_supp(spark, sf))).select("symbol", "date", "train_end", "val_end", "split")


@query
def w17_split_random(spark, sf):
    return splits.split_three_at_random(positions(bars_supp(spark, sf))).groupBy("symbol", "split").agg(F.count("*").alias("rows"))


@query
def w17_split_random_two(spark, sf):
    return splits.split_at_random(positions(bars_supp(spark, sf))).groupBy("symbol", "split").agg(F.count("*").alias("rows"))


@query
def w18_expanding_folds(spark, sf):
    return splits.expanding_folds(positions(bars_supp(spark, sf)), 5).groupBy("symbol", "fold", "role").agg(
        F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query
def w19_date_steps(spark, sf):
    return with_layer(bars_supp(spark, sf), 1, lambda w: {"step": F.datediff("date", w.lag("date", 1))})


# ---- sort, limit, top-k, sets ------------------------------------------------------------------------------------


@query
def k1_order_limit(spark, sf):
    return tidy(B.bars_between(bars_supp(spark, sf), "1", limit=20))


@query
def k2_tail(spark, sf):
    return tidy(forecast.latest_rows(positions(bars_supp(spark, sf)), 3).select("symbol", "date", "close"))


@query
def k2_last_row(spark, sf):
    return tidy(forecast.last_row(bars_supp(spark, sf)))


@query
def k3_top_features(spark, sf):
    rows = splits.split_by_fraction(training_rows(engineer_features(bars_flag(spark, sf))))
    chosen = prepare.select_features(rows.na.fill(0.0, SCORED), SCORED, 50)
    return chosen.select("symbol", "feature", "rank")


@query
def k4_compare_models(spark, sf):
    digits = {f"{s}_{m}": 3 for s in ("test", "val") for m in ("mae", "rmse")}
    return tidy(comparison(spark, sf), cv_score_mean=2, cv_score_std=2, **digits)


@query
def k5_best_model(spark, sf):
    return tidy(evaluate.best_models(comparison(spark, sf)).select("symbol", "model", "test_mse", "test_r2"))


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Run log of the forecasters: one run per (symbol, model), metrics under plain keys."""
    m = evaluate.training_metrics(forecasts(spark, sf))
    run = runs.key_of("symbol", "model")
    at = F.timestamp_seconds(F.lit(1704067200) + F.ascii("symbol") * 60)
    metrics = runs.metric_rows(m, run, runs.key_of("split", "metric"), "value", at)
    params = runs.param_rows(m.select("symbol", "model").distinct(), run, F.lit("config"), F.to_json(F.struct("symbol", "model")), at)
    return metrics.unionByName(params)


@query
def s23_run_log(spark, sf):
    path = fresh_path(spark, "runs")
    runs.append(run_log(spark, sf), path)
    log = spark.read.parquet(path)
    return tidy(log.select("run_id", "kind", "key", F.when(F.col("kind") == "param", F.col("value")).alias("value"), "number"), number=2)


@query
def k6_best_runs(spark, sf):
    wide = runs.runs_wide(run_log(spark, sf), ["test_mse", "test_r2"])
    return tidy(runs.best_runs(wide, "test_mse", True, 5).select("run_id", "test_mse", "test_r2"))


@query
def k7_search_runs(spark, sf):
    wide = runs.runs_wide(run_log(spark, sf), ["test_mse", "val_mae"])
    return tidy(runs.search_runs(wide, "val_mae > 0 AND test_mse IS NOT NULL", 7).select("run_id", "test_mse", "val_mae"), val_mae=3)


@query
def x1_union(spark, sf):
    parts = B.symbols(bars_events(spark, sf)), B.date_ranges(bars_flag(spark, sf))
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


@query
def x2_difference(spark, sf):
    old, new = upsert_parts(spark, sf)
    return old.select("symbol", "date").exceptAll(new.select("symbol", "date"))


@query
def x3_distinct(spark, sf):
    return bars_flag(spark, sf).select("symbol", F.year("date").alias("year")).distinct()


# ---- validation --------------------------------------------------------------------------------------------------


def finding_query(*checks: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = validate.findings(faulty_raw(spark, sf))
        return found.where(F.col("check").isin(*checks)).select("dataset", "check", "column", "severity", "n")
    return run


QUERIES |= {
    "v2_columns": finding_query("columns"),
    "v3_types": finding_query("type"),
    "v4_missing": finding_query("missing"),
    "v5_duplicates": finding_query("duplicates", "date_range"),
    "v6_gaps": finding_query("gaps"),
    "v7_length": finding_query("length"),
    "v8_signs": finding_query("negative", "zero"),
    "v9_outliers": finding_query("outliers"),
    "v10_ohlc": finding_query(*validate.STRUCTURE),
}


@query
def v1_empty(spark, sf):
    expected = B.symbols(bars_supp(spark, sf)).withColumnRenamed("symbol", "dataset")
    raw = supplier_raw(spark, sf).where(F.col("dataset").cast("int") % 5 != 0)
    return validate.findings(raw, expected=expected).where(F.col("check") == "empty").select("dataset", "check", "severity")


@query
def v9_outlier_counts(spark, sf):
    spiked = bars_supp(spark, sf).withColumn("close", F.when(F.dayofyear("date") == 100, F.col("close") * 50).otherwise(F.col("close")))
    return validate.outlier_counts(spiked.withColumnRenamed("symbol", "dataset"))


@query
def v10_bad_rows(spark, sf):
    return tidy(validate.inconsistent_rows(faulty_raw(spark, sf)).groupBy("dataset", "relation").agg(F.count("*").alias("rows")))


@query
def v11_verdicts(spark, sf):
    raw = supplier_raw(spark, sf)
    return validate.verdicts(raw, validate.findings(raw)).select("dataset", "errors", "is_valid")


@query
def v11_totals(spark, sf):
    raw = supplier_raw(spark, sf)
    return validate.totals(validate.verdicts(raw, validate.findings(raw)))


@query
def v11_fail_fast(spark, sf):
    return validate.first_failure(supplier_raw(spark, sf))


@query
def v11_fail_fast_faulty(spark, sf):
    return validate.first_failure(faulty_raw(spark, sf))


@query
def v12_metric_input(spark, sf):
    real, pred = metric_sides(spark, sf)
    try:
        evaluate.check_input(real, pred)
        reason = "none"
    except evaluate.MetricInputError as e:
        reason = e.reason
    return evaluate.alignment(real, pred).withColumn("reason", F.lit(reason))


# ---- preparation and models --------------------------------------------------------------------------------------


PREPARED = FeatureSpec().names


def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.split_by_fraction(training_rows(engineer_features(bars_flag(spark, sf))))
    return rows.select("symbol", "date", "split", "target", *PREPARED)


def tidy_prepared(df: DataFrame, macd: int = 3) -> DataFrame:
    return tidy(df, **{c: 2 if c == "price_volume" else macd if c.startswith("MACD") else 4 for c in PREPARED})


@query
def m1_outliers(spark, sf):
    return tidy_prepared(prepare.replace_outliers(split_rows(spark, sf), PREPARED, fit_on="all").drop("target"))


@query
def m1_outliers_train(spark, sf):
    return tidy_prepared(prepare.replace_outliers(split_rows(spark, sf), PREPARED, threshold=2.0).drop("target"))


def scaled(method: str) -> Query:
    return lambda spark, sf: tidy_prepared(prepare.scale(split_rows(spark, sf), PREPARED, method).drop("target"), macd=4)


QUERIES |= {"m2_standard_scaler": scaled("standard"), "m3_minmax_scaler": scaled("minmax"), "m4_robust_scaler": scaled("robust")}


@query
def m5_select_apply(spark, sf):
    rows = splits.split_by_fraction(training_rows(engineer_features(bars_flag(spark, sf)))).na.fill(0.0, SCORED)
    out = prepare.mask_features(rows, prepare.select_features(rows, SCORED, 50), SCORED)
    return out.groupBy("symbol").agg(*[F.count(c).alias(f"n_{c}") for c in SCORED])


def of_model():
    return Window.partitionBy("symbol", "model")


def prepared_panel(spark: SparkSession, sf: str) -> pipeline.Prepared:
    """The prepared table of a training query; each query makes its own."""
    return pipeline.preprocess(bars_flag(spark, sf))


@query
def m6_preprocess(spark, sf):
    return pipeline.data_shapes(pipeline.preprocess(bars_flag(spark, sf)))


def one_type(model_type: str) -> Query:
    """Train one model type with its default parameters for every symbol; metrics per split."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        prepared = prepared_panel(spark, sf)
        trained = panel.train_panel(prepared.frame, prepared.selected, [model_type])
        return evaluate.training_metrics(trained.predictions(prepared.frame))
    return run


QUERIES |= {
    "m7_decision_tree": one_type("decision_tree"),
    "m8_random_forest": one_type("random_forest"),
    "m9_boosted_trees": one_type("xgboost"),
    "m10_lasso": one_type("lasso"),
}


@query
def m11_defaults_and_boxes(spark, sf):
    """Parameters of every type and symbol: default, and the bounds of both searches."""
    rows = []
    for kind in models.MODEL_TYPES:
        full = models.create_model(kind).params
        rows += [(kind, name, None if value is None else float(value), *[
            None if (box := boxes[kind].get(name)) is None else float(box[i]) for boxes in (models.SEARCH_BOUNDS, models.VALIDATION_SEARCH_BOUNDS) for i in (0, 1)])
            for name, value in full.items()]
    names = ("model", "parameter", "value", "low", "high", "validation_low", "validation_high")
    cells = F.array(*[F.struct(*[F.lit(v).cast("string" if i < 2 else "double").alias(n) for i, (n, v) in enumerate(zip(names, row))]) for row in rows])
    return bars_flag(spark, sf).select("symbol").distinct().select("symbol", F.inline(cells))


@query
def m12_search_folds(spark, sf):
    """Trials of the search over folds, of every type and symbol."""
    prepared = prepared_panel(spark, sf)
    train = prepared.frame.where(F.col("split") == "train")
    tuning = panel.Tuning()
    columns = prepared.spec.names
    chosen = stage(panel.chosen_features(train, prepared.selected), "chosen")
    rows = train.withColumn("role", F.lit(panel.TRAIN))
    n = rows.groupBy("symbol").agg(F.count("*").alias("n"))
    sums = lasso.staged_moments(rows.drop("n").join(n, "symbol"), columns, tuning.folds)
    found = search.tune_by_folds(panel.pack(rows, chosen, columns), sums, chosen, columns, models.MODEL_TYPES, tuning)
    return found.trials.select("symbol", "model", "trial", "params", "score")


@query
def m12_trial_counts(spark, sf):
    """What SQL can know of a search: as many different sets as asked for, all scored, all scores negative errors."""
    trials = m12_search_folds(spark, sf)
    return trials.groupBy("symbol", "model").agg(
        F.count("*").alias("trials"), F.count_distinct("trial").alias("numbers"), F.count("score").alias("scored"), F.max(F.col("score") > 0).alias("positive"))


@query
def m13_search_validation(spark, sf):
    rows = supervised_frame(bars_supp(spark, sf).withColumn("today", F.col("close")))
    tuned = search.tune_on_validation(rows, ["open", "high", "low", "volume"], models.MODEL_TYPES)
    pairs = tuned.predictions.select("symbol", "model", F.col("split").alias("dataset"), F.col("target").alias("y_real"), F.col("prediction").alias("y_pred"))
    return evaluate.metric_rows(pairs, ("mape", "r2"), by=("symbol", "model", "dataset"))


@query
def m14_train_and_score(spark, sf):
    prepared = prepared_panel(spark, sf)
    trained = panel.train_panel(prepared.frame, prepared.selected, folds=pipeline.PipelineConfig().cross_validation_folds)
    return evaluate.compare_models(evaluate.training_metrics(trained.predictions(prepared.frame)), trained.cv)


@query
def m15_train_all(spark, sf):
    """Rows and mean prediction of every type and split; on train rows, means that SQL knows: models with free leaf values or a free intercept are
    right on average."""
    prepared = prepared_panel(spark, sf)
    trained = panel.train_panel(prepared.frame, prepared.selected)
    exact = (F.col("split") == "train") & F.col("model").isin("decision_tree", "lasso")
    learned = F.when(F.col("split") == "train", F.col("target"))
    lowest, highest = F.min(learned).over(of_model()), F.max(learned).over(of_model())
    rows = trained.predictions(prepared.frame).withColumns({"lowest": lowest, "highest": highest})
    inside = F.col("prediction").between(F.col("lowest") - 1e-6, F.col("highest") + 1e-6) | ~F.col("model").isin("decision_tree", "random_forest")
    facts = rows.groupBy("symbol", "model", "split").agg(
        F.count("prediction").alias("rows"), F.avg("prediction").alias("mean"), F.min(inside).alias("inside_train"))
    return tidy(facts.withColumn("mean", F.when(exact, F.col("mean"))), mean=2)


@query
def m15_predictions_by_type(spark, sf):
    """Mean prediction and error of every type, symbol and split."""
    prepared = prepared_panel(spark, sf)
    rows = panel.train_panel(prepared.frame, prepared.selected).predictions(prepared.frame)
    return tidy(rows.groupBy("symbol", "model", "split").agg(
        F.count("*").alias("rows"), F.avg("prediction").alias("mean_prediction"), F.avg(F.abs(F.col("prediction") - F.col("target"))).alias("mean_error")))


@query
def m15_pooled(spark, sf):
    """One pooled model per type for many symbols."""
    prepared = pipeline.preprocess(bars_supp(spark, sf))
    trained = panel.train_panel(prepared.frame, prepared.spec.names, params={"lasso": {"alpha": 0.01}}, mode="pooled")
    return evaluate.training_metrics(trained.predictions(prepared.frame), by=("model", "split"))


@query
def m16_predict(spark, sf):
    """Test rows as every trained type predicts them."""
    prepared = prepared_panel(spark, sf)
    trained = panel.train_panel(prepared.frame, prepared.selected)
    return trained.predictions(prepared.frame.where(F.col("split") == "test"))


@query
def m17_ensemble_weights(spark, sf):
    return tidy(forecast.ensemble_weights(forecasts(spark, sf).where(F.col("split") == "val")))


@query
def m17_equal_weights(spark, sf):
    return tidy(forecast.ensemble_weights(forecasts(spark, sf).where(F.col("split") == "val"), "equal"))


@query
def m18_model_predictions(spark, sf):
    return tidy(forecasts(spark, sf).select("symbol", "date", "model", "prediction"))


@query
def m19_ensemble(spark, sf):
    rows = forecasts(spark, sf)
    weights = forecast.ensemble_weights(rows.where(F.col("split") == "val"))
    return tidy(forecast.combine(rows.where(F.col("split") == "test"), weights))


@query
def m19_simple_average(spark, sf):
    rows = forecasts(spark, sf).where(F.col("split") == "test")
    return tidy(forecast.combine(rows, method="simple_average"))


@query
def m20_backtest(spark, sf):
    return tidy(backtest_rows(spark, sf))


@query
def m20_backtest_models(spark, sf):
    """Backtest with trained models of every type instead of SQL forecasters: what SQL can know of its rows."""
    rows = pipeline.run_experiment(bars_flag(spark, sf), prediction_days=30, at=T0).predictions
    value, actual = F.col("predicted_value"), F.col("actual_value")
    inside = (F.col("confidence_lower") <= value) & (value <= F.col("confidence_upper"))
    wrong = F.abs(F.col("absolute_error") - F.abs(value - actual)) > 1e-9
    return tidy(rows.select(
        "symbol", "timestamp", "actual_value", "model_used", "prediction_horizon", inside.alias("inside_band"),
        (actual.isNull() == F.col("absolute_error").isNull()).alias("error_if_actual"), F.coalesce(wrong, F.lit(False)).alias("wrong_error")))


@query
def m21_next_value(spark, sf):
    bars = bars_flag(spark, sf)
    weights = forecast.ensemble_weights(forecasts(spark, sf).where(F.col("split") == "val"))
    return tidy(forecast.next_value(engineer_features(bars), FORECASTERS, weights))


@query
def m22_chart_series(spark, sf):
    bars = bars_flag(spark, sf).withColumn("today", F.col("close"))
    frame = splits.split_by_ratio(supervised_frame(bars)).withColumnRenamed("today", "close")
    predictions = feature_columns(spark, sf, "MA_5").withColumnRenamed("MA_5", "prediction")
    return tidy(forecast.chart_series(frame, predictions), actual=3)


@query
def m23_split_rule(spark, sf):
    shares = splits.split_ratios(70, 20, 20)
    shorter = splits.split_ratios(50, 20, 10)
    rows = stage(positions(bars_supp(spark, sf)).select("pos", "n"), "positions")  # both rules read it
    parts = [
        splits.split_by_ratio(rows, s).groupBy("split").agg(F.count("*").alias("rows")).withColumn("rule", F.lit(name))
        for name, s in (("over", shares), ("under", shorter))
    ]
    return parts[0].unionByName(parts[1])


@query
def m24_pipeline(spark, sf):
    """The experiment with its default configuration: what SQL can know of its summary."""
    results = pipeline.run_experiment(bars_flag(spark, sf), pipeline.PipelineConfig(), 30, fresh_path(spark, "experiments"), at=T0)
    told = ["symbols", "models", "total_predictions", "predictions_with_actuals"]
    return results.summary.select(
        "symbol", *told, F.coalesce(F.col("best_model").isin(*models.MODEL_TYPES), F.lit(False)).alias("best_is_known"), (F.col("avg_test_mse") > 0).alias("scored"))


@query
def m24_pipeline_whole(spark, sf):
    """The whole pipeline: every model type, tuned before its fit."""
    config = pipeline.PipelineConfig(enable_tuning=True)
    results = pipeline.run_experiment(bars_flag(spark, sf), config, 30, fresh_path(spark, "experiments"), at=T0)
    return results.summary


@query
def k8_importance(spark, sf):
    prepared = prepared_panel(spark, sf)
    return panel.train_panel(prepared.frame, prepared.selected).importances()


@query
def k8_importance_totals(spark, sf):
    """Importances of a model of trees sum to 1; linear models have none."""
    rows = k8_importance(spark, sf)
    return tidy(rows.groupBy("symbol", "model").agg(F.count("*").alias("features"), F.sum("importance").alias("total"), F.min(F.col("importance") >= 0).alias("none_negative")))


@query
def s19_prediction_sink(spark, sf):
    path = fresh_path(spark, "forecasts")
    rows = stage(backtest_rows(spark, sf), "predictions")
    weights = forecast.ensemble_weights(forecasts(spark, sf).where(F.col("split") == "val"))
    sinks.save_predictions(rows, path, weights, horizon=1)
    side = spark.read.json(f"{path}/metadata")
    saved = spark.read.option("header", True).schema(rows.schema).csv(f"{path}/predictions")
    return tidy(saved.groupBy("symbol").agg(F.count("*").alias("rows"), F.avg("predicted_value").alias("mean")).join(
        side.select("symbol", F.col("summary_stats.total_predictions").alias("in_sidecar")), "symbol"))


@query
def s20_experiment_sink(spark, sf):
    path = fresh_path(spark, "experiment")
    table_ = stage(comparison(spark, sf), "comparison")
    sinks.save_experiment("exp_1", table_, evaluate.experiment_overview(table_), path)
    back = spark.read.option("header", True).csv(f"{path}/comparison")
    return back.groupBy("experiment_id", "symbol").agg(F.count("*").alias("models"))


@query
def s21_metrics_sink(spark, sf):
    path = fresh_path(spark, "metrics")
    sinks.save_metrics(evaluate.metric_rows(regression_pairs(spark, sf), ("mape", "r2")), path, "daily", T0)
    back = spark.read.option("header", True).csv(f"{path}/daily")
    return tidy(back.select("dataset", F.col("mape").cast("double").alias("mape"), F.col("r2").cast("double").alias("r2"), "run_ts"))


@query
def s22_model_sink(spark, sf):
    """Models of every type, saved and loaded as tables, say the same."""
    path = fresh_path(spark, "models")
    prepared = prepared_panel(spark, sf)
    pipeline.save_preprocessor(prepared, f"{path}/preprocessor")
    prepared = pipeline.load_preprocessor(spark, f"{path}/preprocessor", prepared.frame, prepared.spec)
    trained = panel.train_panel(prepared.frame, prepared.selected)
    trained.save(path)
    before = stage(trained.predictions(prepared.frame), "before")
    after = panel.TrainedPanel.load(spark, path).predictions(prepared.frame).withColumnRenamed("prediction", "again")
    same = F.col("prediction") == F.col("again")
    return before.join(after.drop("split", "target"), ["symbol", "date", "model"]).groupBy("symbol", "model", "split").agg(
        F.count("*").alias("rows"), F.count_if(same).alias("same"))


@query
def u1_metric_registry(spark, sf):
    pairs = regression_pairs(spark, sf)
    out = evaluate.metric_rows(pairs, tuple(evaluate.M.REGISTRY["regression"]))
    return tidy(out, rmse=3)


@query
def u2_model_factory(spark, sf):
    """Every model type by name with the defaults of a request: what SQL can know of its predictions of the train rows."""
    prepared = prepared_panel(spark, sf)
    train = prepared.frame.where(F.col("split") == "train")
    trained = panel.train_panel(train, prepared.selected, params=models.REQUEST_DEFAULTS)
    rows = trained.predictions(train)
    # a tree without limits repeats its train rows (where features tell them apart), a forest stays inside their range
    close_to = F.abs(F.col("prediction") - F.col("target")) < 1e-6
    lowest, highest = F.min("target").over(of_model()), F.max("target").over(of_model())
    inside = F.col("prediction").between(lowest - 1e-6, highest + 1e-6)
    facts = rows.withColumns({"same": close_to | (F.col("model") != "decision_tree"), "inside": inside | ~F.col("model").isin("decision_tree", "random_forest")})
    return facts.groupBy("symbol", "model").agg(F.count("*").alias("rows"), F.min("same").alias("tree_repeats"), F.min("inside").alias("inside_train"))


@query
def u3_objective(spark, sf):
    """The search's objective at one parameter set. So strong a penalty leaves the train mean, whose score SQL knows too."""
    rows = supervised_frame(bars_flag(spark, sf).withColumn("today", F.col("close")))
    _, packed, chosen = search.by_validation(rows, ["open", "high", "low", "volume"])
    asked = stage(panel.asked_models(chosen, {"lasso": {"alpha": 1e12}}), "asked")
    return tidy(search.validation_scores(packed, asked).select("symbol", F.lit(1e12).alias("alpha"), "score"))


def train_means(model_type: str) -> Query:
    """A model whose least-squares fit has free leaf values or a free intercept predicts its train rows right on average."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        prepared = prepared_panel(spark, sf)
        trained = panel.train_panel(prepared.frame, prepared.selected, [model_type])
        rows = trained.predictions(prepared.frame.where(F.col("split") == "train"))
        return tidy(rows.groupBy("symbol", "model").agg(F.count("*").alias("rows"), F.avg("prediction").alias("mean_prediction")), mean_prediction=2)
    return run


QUERIES |= {"m7_train_means": train_means("decision_tree"), "m10_train_means": train_means("lasso")}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Moving averages, Bollinger bands and returns of every symbol in one pass."""
    return feature_columns(spark, sf, "returns", "MA_5", "MA_10", "MA_20", "MA_20_ratio", "BB_upper", "BB_lower", "BB_position", "RSI", "MACD_signal")


QUERIES["flagship"] = flagship
__all__ = ["QUERIES", "derived", "flagship"]
