from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barline.operators import validate
from barline.plans import pipeline, queries
from barline.sources import bars as B
from barline.sources import lake, runs, sinks, store
from barline.sources.scratch import MANY_FILES, fresh_path, shared_dir, stage

T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def write_csv(path, name, rows):
    path.mkdir(exist_ok=True)
    lines = ["SNo,Name,Symbol,Date,High,Low,Open,Close,Volume,Marketcap"]
    lines += [f"{i + 1},Coin,CN,{d} 23:59:59,{c + 1},{c - 1},{c},{c},{v},100.0" for i, (d, c, v) in enumerate(rows)]
    (path / f"{name}.csv").write_text("\n".join(lines) + "\n")


def test_directory_read(spark, tmp_path):
    write_csv(tmp_path, "one", [("2020-01-02", 5.0, 0.0), ("2020-01-01", 4.0, 1.0)])
    write_csv(tmp_path, "two", [("2020-01-01", 9.0, 2.0)])
    bars = B.normalise(B.read_raw(spark, str(tmp_path)))
    got = {(r.symbol, r.date): r.close for r in bars.collect()}
    assert got == {("ONE", date(2020, 1, 1)): 4.0, ("ONE", date(2020, 1, 2)): 5.0, ("TWO", date(2020, 1, 1)): 9.0}
    assert [f.name for f in bars.schema] == B.BAR_COLUMNS
    assert B.keep_long_series(bars, 0).select("symbol").distinct().collect()[0].symbol == "ONE"


def test_text_read_reports_bad_types(spark, tmp_path):
    write_csv(tmp_path, "one", [("2020-01-01", 5.0, "n/a"), ("2020-01-02", 4.0, 1.0)])
    cols = [f.name for f in B.RAW_SCHEMA]
    found = validate.findings(B.read_text_bars(spark, str(tmp_path), cols))
    keys = {(r.check, r.column): r.severity for r in found.collect()}
    assert keys[("type", "volume")] == "warning" and keys[("length", "date")] == "error"
    assert keys[("columns", "SNo")] == "warning"


def test_missing_column_is_refused(spark, make_bars):
    with pytest.raises(ValueError, match="Missing required columns"):
        B.normalise(make_bars({"A": [1.0]}).drop("high"), "symbol")


def test_nan_becomes_null(make_bars):
    row = B.normalise(make_bars({"a": [1.0]}, volume=float("nan")), "symbol").first()
    assert row.volume is None and row.symbol == "A"


def test_bar_table_round_trip(spark, make_bars):
    table = store.BarTable(spark, fresh_path(spark, "bars"), buckets=4)
    table.create(make_bars({"A": [1.0, 2.0], "B": [5.0]}), T0)
    added = table.upsert(make_bars({"A": [1.5, 2.5, 3.5], "C": [7.0]}), T1)
    assert added == 2
    rows = {(r.symbol, r.close): (r.created_at, r.updated_at) for r in table.read().collect()}
    assert set(rows) == {("A", 1.5), ("A", 2.5), ("A", 3.5), ("B", 5.0), ("C", 7.0)}
    assert rows[("A", 1.5)] == (T0, T1) and rows[("A", 3.5)] == (T1, T1) and rows[("B", 5.0)] == (T0, T0)
    assert [r.close for r in table.scan("a", limit=2).collect()] == [1.5, 2.5]
    assert [r.close for r in table.scan("A", "2015-01-02", "2015-01-02").collect()] == [2.5]
    assert table.delete("A") == 3 and table.delete("A") == 0
    assert {r.symbol for r in table.read().collect()} == {"B", "C"}
    assert table.upsert(make_bars({"A": [9.0]}), T1) == 1


def test_a_write_that_stops_before_its_manifest_changes_nothing(spark, make_bars, monkeypatch):
    table = store.BarTable(spark, fresh_path(spark, "bars"), buckets=2).create(make_bars({"A": [1.0, 2.0], "B": [5.0]}), T0)

    def lost(*_):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as m:
        m.setattr(store.BarTable, "_commit", lost)
        for write in (lambda: table.upsert(make_bars({"A": [9.0, 9.0, 9.0]}), T1), lambda: table.delete("B")):
            with pytest.raises(RuntimeError):
                write()
    assert sorted((r.symbol, r.close) for r in table.read().collect()) == [("A", 1.0), ("A", 2.0), ("B", 5.0)]
    # what the stopped write left isn't taken for the next one's
    assert table.upsert(make_bars({"A": [3.0]}), T1) == 0
    assert sorted((r.symbol, r.close) for r in table.read().collect()) == [("A", 2.0), ("A", 3.0), ("B", 5.0)]


def test_versions_and_concurrent_writers(spark, make_bars):
    table = store.BarTable(spark, fresh_path(spark, "bars"), buckets=2).create(make_bars({"A": [1.0]}), T0)
    late = table.at_version(0)  # a writer that began before the next write
    table.upsert(make_bars({"A": [2.0], "B": [5.0]}), T1)
    with pytest.raises(store.ConcurrentWrite):
        late.upsert(make_bars({"A": [7.0]}), T1)
    assert sorted((r.symbol, r.close) for r in table.read().collect()) == [("A", 2.0), ("B", 5.0)]
    assert [r.close for r in table.at_version(0).read().collect()] == [1.0] and table.current() == 1
    table.delete("B")
    assert [r.symbol for r in table.read().collect()] == ["A"] and table.at_version(1).read().count() == 2
    table.delete("A")
    assert table.read().count() == 0 and table.upsert(make_bars({"C": [1.0]}), T1) == 1
    empty = store.BarTable(spark, fresh_path(spark, "bars"), buckets=2).create(make_bars({"A": [1.0]}).limit(0), T0)
    assert empty.read().count() == 0 and empty.upsert(make_bars({"C": [1.0]}), T1) == 1


def test_an_upsert_leaves_other_parts_alone(spark, make_bars):
    table = store.BarTable(spark, fresh_path(spark, "bars"), buckets=2).create(make_bars({"A": [1.0] * 800}), T0)
    before = {(r.bucket, r.year): r.since for r in table.manifest().collect()}
    table.upsert(make_bars({"A": [2.0]}), T1)
    after = {(r.bucket, r.year): r.since for r in table.manifest().collect()}
    assert before.keys() == after.keys() and sum(before[k] != after[k] for k in before) == 1
    assert table.read().where("close = 2").count() == 1 and table.read().count() == 800


def test_files_with_different_headers(spark, make_bars, tmp_path):
    (tmp_path / "good.csv").write_text("Date,Open,High,Low,Close\n" + "".join(f"{2015 + i // 365}-{1 + i % 365 // 31:02d}-{1 + i % 365 % 28:02d},1,2,1,1\n" for i in range(3)))
    (tmp_path / "other.csv").write_text('"Close",Low,"High",Open,Date,Note\n5,4,6,5,2015-01-01,"a, b"\n')
    (tmp_path / "short.csv").write_text("Date,Close\n2015-01-01,7\n")
    (tmp_path / "bare.csv").write_text("Date,Open,High,Low,Close\n")
    (tmp_path / "nothing.csv").write_text("")
    files = B.read_by_header(spark, str(tmp_path))
    rows = {(r.dataset, r.date): (r.open, r.close, r.note) for r in files.rows.collect()}
    assert rows["other", "2015-01-01"] == ("5", "5", "a, b") and rows["short", "2015-01-01"] == (None, "7", None) and len(rows) == 5
    headers = {r.dataset: r.columns for r in files.headers.collect()}
    assert headers["short"] == ["close", "date"] and "note" in headers["other"] and len(headers) == 4
    expected = files.headers.select("dataset").unionByName(spark.createDataFrame([("nothing",)], "dataset string"))
    found = {(r.dataset, r.check, r.column): r.severity for r in validate.findings(files.rows, expected=expected, headers=files.headers).collect()}
    assert found["short", "columns", "open"] == "error" and found["other", "columns", "note"] == "warning" and found["nothing", "empty", ""] == "error"
    assert found["bare", "empty", ""] == "error" and ("short", "missing", "open") not in found and ("good", "columns", "open") not in found
    table = store.BarTable(spark, fresh_path(spark, "bars"), buckets=2).create(make_bars({"Z": [1.0]}), T0)
    jobs = {r.symbol: r.status for r in pipeline.import_bars(files.rows, table, T1, min_years=0, headers=files.headers).jobs.collect()}
    assert jobs["OTHER"] == "completed" and jobs["GOOD"] == "completed" and {jobs[s] for s in ("SHORT", "BARE")} == {"failed"}


def test_files_of_headers_are_listed_in_few_tasks_and_opened_once(spark, tmp_path):
    for i in range(300):
        folder = tmp_path / f"dataset={i} b"
        folder.mkdir()
        (folder / "one two.csv").write_text(f"\n \nDate,Close\n2015-01-01,{i}\n\nDate,Close\n" if i % 2 else f"Close,Note\n{i},x\n")
    (tmp_path / "blank.csv").write_text("\n\n")
    before, key = spark.sparkContext.statusTracker(), "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    default = spark.conf.get(key)
    spark.sparkContext.setJobGroup("listing", "listing")
    files = B.read_by_header(spark, str(tmp_path))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [before.getStageInfo(s) for j in before.getJobIdsForGroup("listing") for s in before.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) < 300 and spark.conf.get(key) == default
    for file in tmp_path.glob("dataset=*/*.csv"):
        file.write_text("gone\n")
    rows = [(r.dataset, r.date, r.close, r.note) for r in files.rows.collect()]
    assert sorted(rows, key=str) == sorted([
        r for i in range(300) for r in ([(f"{i} b", "2015-01-01", str(i), None), (f"{i} b", "Date", "Close", None)] if i % 2 else [(f"{i} b", None, str(i), "x")])
    ], key=str)
    headers = {r.dataset: r.columns for r in files.headers.collect()}
    assert headers["blank"] == [] and headers["1 b"] == ["close", "date"] and len(headers) == 301


def test_the_last_row_of_a_file_in_parts_wins(spark, tmp_path):
    (tmp_path / "A.csv").write_text("Date,Open,High,Low,Close\n" + "".join(f"2015-01-01,{i},{i},{i},{i}\n" for i in range(100, 400)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    try:
        files = B.read_by_header(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    ranked = [int(r.close) for r in files.rows.orderBy("_rank").collect()]
    assert ranked == list(range(100, 400)) and "_rank" not in validate.columns_of(files.rows)
    bars = B.latest_bars(B.normalise(files.rows.withColumn("version", F.col("_rank")), keep=("version",)), "version")
    assert [r.close for r in bars.collect()] == [399.0]


def test_checks_of_columns_scan_no_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Close,Note\n2015-01-01,1,x\n")
    files = B.read_by_header(spark, str(tmp_path))
    unread = files.rows.withColumn("date", F.raise_error(F.lit("scanned")).cast("string"))
    some = {(r.dataset, r.column, r.severity, r.message) for r in validate.findings(unread, headers=files.headers, checks=["columns"]).collect()}
    every = validate.findings(files.rows, headers=files.headers)
    assert some == {(r.dataset, r.column, r.severity, r.message) for r in every.where("check = 'columns'").collect()} and len(some) == 4
    both = validate.findings(files.rows, headers=files.headers, checks=["columns", "length"])
    assert sorted(both.collect()) == sorted(every.where("check IN ('columns', 'length')").collect())


def test_scan_prunes_partitions(spark, make_bars):
    table = store.BarTable(spark, fresh_path(spark, "bars"), buckets=4).create(make_bars({"A": [1.0], "B": [2.0]}), T0)
    plan = table.scan("A", "2015-01-01", "2015-12-31")._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in filters and "year" in filters and "EqualTo(symbol,A)" in plan


def test_sources_and_jobs(spark):
    known = spark.createDataFrame([("a", "old")], "name string, description string")
    incoming = spark.createDataFrame([("a", "new"), ("b", "new"), ("b", "new")], "name string, description string")
    assert sorted((r.name, r.description) for r in store.add_sources(known, incoming).collect()) == [("a", "old"), ("b", "new")]
    started = store.jobs_started(spark.createDataFrame([("x",), ("y",)], "symbol string"), "csv", F.lit(T0))
    outcome = spark.createDataFrame(
        [("X", [], ["w"], 10, 4), ("Y", ["bad"], [], 10, 0)],
        "symbol string, errors array<string>, warnings array<string>, records_processed long, records_inserted long")
    state = {r.symbol: r for r in store.current_jobs(started.unionByName(store.jobs_finished(started, outcome, F.lit(T1)))).collect()}
    assert (state["X"].status, state["X"].records_updated) == ("completed", 6)
    assert state["Y"].error_message == "Validation failed: bad" and state["Y"].records_processed == 0


def test_import_keeps_valid_datasets_only(spark, make_bars):
    good = make_bars({"g": [10.0] * 800}).withColumnRenamed("symbol", "dataset")
    bad = make_bars({"b": [-10.0] * 800}).withColumnRenamed("symbol", "dataset")
    table = store.BarTable(spark, fresh_path(spark, "bars"), buckets=2).create(make_bars({"G": [1.0]}), T0)
    report = pipeline.import_bars(good.unionByName(bad), table, T1)
    jobs = {r.symbol: r for r in report.jobs.collect()}
    assert jobs["G"].status == "completed" and jobs["B"].status == "failed"
    assert report.inserted == 799 == jobs["G"].records_inserted and jobs["G"].records_updated == 1
    assert table.read().select("symbol").distinct().count() == 1
    assert jobs["G"].records_skipped == 0 and str(jobs["G"].data_start_date) == "2015-01-01" and jobs["B"].data_end_date is None


def test_import_reads_its_rows_once(spark, make_bars):
    rows = make_bars({"a": [10.0 + i % 9 for i in range(800)]}).withColumnRenamed("symbol", "dataset")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    table = store.BarTable(spark, fresh_path(spark, "bars"), buckets=2).create(make_bars({"G": [1.0]}), T0)
    job = pipeline.import_bars(rows.mapInArrow(count, rows.schema), table, T1).jobs.first()
    assert (job.status, job.records_processed, job.records_inserted) == ("completed", 800, 800)
    assert seen.value == 800


def test_import_counts_rows_without_a_price_as_skipped(spark, make_bars):
    raw = make_bars({"g": [10.0] * 900}).withColumnRenamed("symbol", "dataset")
    raw = raw.withColumn("open", F.when(F.dayofyear("date") % 20 != 0, F.col("open")))
    table = store.BarTable(spark, fresh_path(spark, "bars"), buckets=2).create(make_bars({"G": [1.0]}), T0)
    job = pipeline.import_bars(raw, table, T1).jobs.first()
    gaps = raw.where("open IS NULL").count()
    assert gaps > 30 and (job.records_processed, job.records_inserted, job.records_updated, job.records_skipped) == (900, 899 - gaps, 1, gaps)


def test_lake(spark, make_bars, tmp_path):
    root = str(tmp_path / "lake")
    bars = make_bars({"A": [1.0], "B": [2.0]})
    lake.ingest(bars, root, "raw", "symbol")
    lake.ingest(bars, root, "processed", "symbol", "transformed")
    path = lake.archive(bars, root, "bars", T0)
    assert path.endswith("archive/bars/archived_at=20240101_000000")
    files = lake.listing(spark, root)
    report = {(r.zone, r.kind, r.name): r.files for r in lake.inventory(files).collect()}
    assert report[("raw", "zone", "")] >= 2 and report[("processed", "folder", "transformed")] >= 2
    assert any(kind == "extension" and name == ".parquet" for _, kind, name in report)
    assert lake.retention_report(files, "2200-01-01").count() == files.count()
    assert lake.retention_report(files, "2000-01-01").count() == 0
    assert lake.zone_path("r", "raw", "log") == "r/raw/logs"
    lake.save_inventory(lake.inventory(files), str(tmp_path / "report"))


def test_run_log(spark):
    rows = spark.createDataFrame([("r1", 3.0), ("r2", 1.0), ("r3", float("nan")), ("r4", None)], "run string, v double")
    log = runs.metric_rows(rows, F.col("run"), F.lit("test_mse"), "v", F.lit(T0))
    assert log.count() == 2
    wide = runs.runs_wide(log.unionByName(runs.params_from_dict(spark, "r5", {"a": [1], "b": 2}, T1)), ["test_mse"])
    assert [r.run_id for r in runs.best_runs(wide, "test_mse", True, 1).collect()] == ["r2"]
    assert [r.run_id for r in runs.search_runs(wide, limit=1).collect()] == ["r5"]
    assert [r.run_id for r in runs.search_runs(wide, "test_mse > 2").collect()] == ["r1"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("A", date(2020, 1, 1), 1.0, 2.0)], "symbol string, timestamp date, predicted_value double, actual_value double")
    weights = spark.createDataFrame([("A", "x", 1.0)], "symbol string, model string, weight double")
    sinks.save_predictions(rows, str(tmp_path / "p"), weights, horizon=1)
    side = spark.read.json(str(tmp_path / "p/metadata")).first()
    assert side.summary_stats.mse == 1.0 and side.ensemble_weights.x == 1.0 and side.metadata.horizon == "1"
    sinks.save_metrics(rows.select("symbol", "predicted_value"), str(tmp_path / "m"), "daily", T0)
    assert spark.read.option("header", True).csv(str(tmp_path / "m/daily")).first().run_ts == "2024-01-01 00:00:00"


def test_stage_uses_the_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = stage(spark.range(10), "numbers")
    assert df.count() == 10 and shared_dir(spark) in df.inputFiles()[0]


def test_many_files_are_written_without_checksums(spark, tmp_path):
    """A file per dataset costs no checksum file beside it; files are those of a plain write."""
    rows = spark.createDataFrame([(s, i, f"{s} {i}") for s in ("A", "b c", "d") for i in range(3)], "dataset string, i int, text string")
    for name, options in (("plain", {}), ("many", MANY_FILES)):
        rows.repartition("dataset").write.options(**options).option("header", True).partitionBy("dataset").csv(str(tmp_path / name))
    kept = {name: sorted(p.name for p in (tmp_path / name).rglob("*.crc")) for name in ("plain", "many")}
    assert kept["plain"] and not kept["many"]
    files = {name: sorted((p.parent.name, p.read_text()) for p in (tmp_path / name).rglob("*.csv")) for name in ("plain", "many")}
    assert files["plain"] == files["many"] and len(files["many"]) == 3
    read = B.read_by_header(spark, str(tmp_path / "many")).rows.groupBy("dataset").count()
    assert {(r.dataset, r["count"]) for r in read.collect()} == {("A", 3), ("b c", 3), ("d", 3)}


def test_files_of_a_supplier_come_without_checksums(spark, tmp_path):
    lines = [(k, 1, s, 1, 1.0, 10.0 + k, datetime(1995, 1, 1 + k)) for k in range(5) for s in range(4)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    path = Path(queries.files_of_three_layouts(spark, str(tmp_path)))
    assert len([*path.rglob("*.csv")]) == 4 and not [*path.rglob("*.crc")]
