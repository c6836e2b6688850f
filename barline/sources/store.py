"""Stored tables: bars, data sources, import jobs."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.sources.bars import bars_between, latest_bars
from barline.sources.scratch import stage

BAR_VALUES = ["open", "high", "low", "close", "volume", "market_cap"]
AUDIT = ["created_at", "updated_at"]


class ConcurrentWrite(RuntimeError):
    """Another writer made the next version first; the table is as that writer left it."""


class BarTable:
    """Parquet table of bars, key (symbol, date), in parts by a hash bucket of the symbol and the year, with versions.

    A part per symbol would mean a file per symbol; buckets keep files large, and the year keeps an upsert from rewriting a symbol's
    history. Rows are sorted by symbol and date inside a file, so a lookup reads one bucket and skips row groups.

    Files are never changed. A write adds the changed parts under a name of its own, below `data`, and then, as its last step, a manifest: one row
    per part that holds bars, with the write that has its files. Who reads takes the newest manifest, or a pinned one, and so sees whole versions
    only: what stops before the manifest leaves the table as it was. A manifest that is there already is not replaced: of two writers
    that started from one version, the second is refused. Old versions stay until they are cleared away from outside.
    """

    MANIFEST = "bucket int, year int, since string"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, version: int | None = None):
        self.spark, self.path, self.buckets, self.pinned = spark, path, buckets, version

    def bucket(self, symbol: Column) -> Column:
        return F.pmod(F.xxhash64(symbol), F.lit(self.buckets)).cast("int")

    def _placed(self, bars: DataFrame) -> DataFrame:
        have = set(bars.columns)
        values = [(F.col(c) if c in have else F.lit(None)).cast("double").alias(c) for c in BAR_VALUES]
        audit = [(F.col(c) if c in have else F.lit(None)).cast("timestamp").alias(c) for c in AUDIT]
        return bars.select("symbol", "date", *values, *audit).withColumns(
            {"bucket": self.bucket(F.col("symbol")), "year": F.year("date")}
        )

    def current(self) -> int:
        """The newest version, or the pinned one."""
        if self.pinned is not None:
            return self.pinned
        return self.spark.read.schema(f"{self.MANIFEST}, version int").parquet(f"{self.path}/manifests").agg(F.max("version")).first()[0]

    def at_version(self, version: int) -> "BarTable":
        """The table as it was."""
        return BarTable(self.spark, self.path, self.buckets, version)

    def manifest(self, version: int | None = None) -> DataFrame:
        """bucket, year, since: parts with bars, at most buckets * years rows."""
        version = self.current() if version is None else version
        return self.spark.read.schema(self.MANIFEST).parquet(f"{self.path}/manifests/version={version}")

    def _write_parts(self, rows: DataFrame, write: str) -> None:
        # Rebalancing splits a (bucket, year) that is larger than the advisory size and merges small ones.
        (
            rows.hint("rebalance", "bucket", "year").sortWithinPartitions("bucket", "year", "symbol", "date")
            .write.partitionBy("bucket", "year").parquet(f"{self.path}/data/since={write}")
        )

    def _commit(self, manifest: DataFrame, version: int) -> None:
        """One row at least, so that an empty table has a manifest too."""
        none = self.spark.createDataFrame([(None, None, None)], self.MANIFEST)
        whole = manifest.select("bucket", "year", "since").unionByName(none).coalesce(1)
        try:
            whole.write.mode("errorifexists").parquet(f"{self.path}/manifests/version={version}")
        except AnalysisException as e:
            if "ALREADY_EXISTS" not in str(e):
                raise
            raise ConcurrentWrite(f"version {version} of {self.path} exists already") from e

    def _parts_of(self, rows: DataFrame, write: str) -> DataFrame:
        return stage(rows.select("bucket", "year").distinct().withColumn("since", F.lit(write)), "touched")

    def create(self, bars: DataFrame, at: datetime) -> "BarTable":
        stamped = stage(self._placed(bars.withColumns({"created_at": F.lit(at), "updated_at": F.lit(at)})), "placed")
        write = uuid.uuid4().hex
        if not stamped.isEmpty():
            self._write_parts(stamped, write)
        self._commit(self._parts_of(stamped, write), 0)
        return self

    def _stored(self, version: int | None = None, bucket: int | None = None) -> DataFrame:
        """Rows of the version's parts, with bucket and year. The manifest is a small list of partitions: broadcast, it prunes the others."""
        schema = ", ".join(["symbol string", "date date", *[f"{c} double" for c in BAR_VALUES], *[f"{c} timestamp" for c in AUDIT], self.MANIFEST])
        parts = self.manifest(version).where(F.col("bucket").isNotNull() if bucket is None else F.col("bucket") == bucket)
        try:
            data = self.spark.read.schema(schema).parquet(f"{self.path}/data")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            data = self.spark.createDataFrame([], schema)  # created without bars
        if bucket is not None:  # a bucket's parts are a handful: a filter that prunes at planning
            held = parts.collect()
            wanted = [(F.col("year") == p.year) & (F.col("since") == p.since) for p in held]
            return data.where((F.col("bucket") == bucket) & (reduce(or_, wanted) if wanted else F.lit(False)))
        return data.join(F.broadcast(parts), ["bucket", "year", "since"], "left_semi")

    def read(self) -> DataFrame:
        return self._stored().drop("bucket", "year", "since")

    def _home(self, symbol: str) -> int:
        return self.spark.range(1).select(self.bucket(F.lit(symbol)).alias("b")).first().b

    def scan(self, symbol: str, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
        """Bars of one symbol in date order; prunes to its bucket and to the years asked for."""
        stored = self._stored(bucket=self._home(symbol.upper()))
        if start:
            stored = stored.where(F.col("year") >= int(start[:4]))
        if end:
            stored = stored.where(F.col("year") <= int(end[:4]))
        return bars_between(stored, symbol, start, end, limit).drop("bucket", "year", "since", *AUDIT)

    def upsert_counts(self, bars: DataFrame, at: datetime) -> DataFrame:
        """Replace the values of known (symbol, date) keys, add the others; returns symbol, inserted, updated.

        Only parts that receive rows are read and written anew, and only they are asked for known keys. `bars` has a row
        per key and is read several times: stage it.
        """
        version, write = self.current(), uuid.uuid4().hex
        incoming = self._placed(bars.withColumns({"created_at": F.lit(at), "updated_at": F.lit(at)}))
        touched = self._parts_of(incoming, write)  # at most buckets * years rows: bounded, so broadcast
        kept = self._stored(version).join(F.broadcast(touched.drop("since")), ["bucket", "year"], "left_semi").drop("since")
        known = incoming.select("bucket", "year", "symbol", "date").join(
            kept.select("bucket", "year", "symbol", "date", F.lit(1).alias("known")), ["bucket", "year", "symbol", "date"], "left")
        counts = stage(known.groupBy("symbol").agg(
            F.count_if(F.col("known").isNull()).alias("inserted"), F.count("known").alias("updated")), "upsert-counts")
        self._write_parts(merge_bars(kept, incoming), write)
        others = self.manifest(version).where("bucket IS NOT NULL").join(touched, ["bucket", "year"], "left_anti")
        self._commit(others.unionByName(touched), version + 1)
        return counts

    def upsert(self, bars: DataFrame, at: datetime) -> int:
        """As upsert_counts; returns how many keys were added."""
        return self.upsert_counts(bars, at).agg(F.coalesce(F.sum("inserted"), F.lit(0))).first()[0]

    def delete(self, symbol: str) -> int:
        """Remove all bars of a symbol; returns how many there were."""
        version, name, write = self.current(), symbol.upper(), uuid.uuid4().hex
        home = self._stored(version, self._home(name))
        gone = home.where(F.col("symbol") == name)
        count = gone.count()
        if count:
            years = stage(gone.select("bucket", "year").distinct(), "touched")
            rest = stage(home.where(F.col("symbol") != name).drop("since").join(F.broadcast(years), ["bucket", "year"], "left_semi"), "rest")
            self._write_parts(rest, write)
            others = self.manifest(version).where("bucket IS NOT NULL").join(years, ["bucket", "year"], "left_anti")
            self._commit(others.unionByName(self._parts_of(rest, write)), version + 1)
        return count


def merge_bars(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert as one aggregate over the union: incoming values win, the first creation time stays."""
    old = stored.withColumn("version", F.lit(0))
    new = incoming.withColumn("version", F.lit(1))
    extra = [c for c in stored.columns if c in ("bucket", "year")]
    values = [c for c in BAR_VALUES if c in stored.columns]
    stamp = [F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at")] if "created_at" in stored.columns else []
    newest = F.max_by(F.struct(*values), "version").alias("bar")
    return old.unionByName(new, allowMissingColumns=True).groupBy("symbol", "date", *extra).agg(newest, *stamp).select(
        "symbol", "date", "bar.*", *[c for c in AUDIT if c in stored.columns], *extra
    )


def new_keys(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return incoming.join(stored, ["symbol", "date"], "left_anti")


def add_sources(sources: DataFrame, incoming: DataFrame) -> DataFrame:
    """Get-or-create by unique name: known sources stay as they are, unknown ones are appended once."""
    fresh = incoming.join(sources, "name", "left_anti").dropDuplicates(["name"])
    return sources.unionByName(fresh, allowMissingColumns=True)


# Import jobs are an append-only log of events; the state of a job is its newest event.
JOB_FIELDS = [
    "job_id", "source", "symbol", "file_path", "status", "records_processed", "records_inserted",
    "records_updated", "records_skipped", "data_start_date", "data_end_date", "error_message", "validation_errors", "at",
]


def job_id(symbol: str | Column, started: Column) -> Column:
    return F.hex(F.xxhash64(F.col(symbol) if isinstance(symbol, str) else symbol, started))


def jobs_started(symbols: DataFrame, source: str, at: Column) -> DataFrame:
    """One pending event per symbol; `symbols` may carry a file_path."""
    path = F.col("file_path") if "file_path" in symbols.columns else F.lit(None).cast("string")
    return symbols.select(
        job_id("symbol", at).alias("job_id"), F.lit(source).alias("source"), F.upper("symbol").alias("symbol"),
        path.alias("file_path"), F.lit("pending").alias("status"),
        F.lit(0).cast("bigint").alias("records_processed"), F.lit(0).cast("bigint").alias("records_inserted"),
        F.lit(0).cast("bigint").alias("records_updated"), F.lit(0).cast("bigint").alias("records_skipped"),
        F.lit(None).cast("date").alias("data_start_date"), F.lit(None).cast("date").alias("data_end_date"),
        F.lit(None).cast("string").alias("error_message"),
        F.lit(None).cast("string").alias("validation_errors"), at.alias("at"),
    )


def jobs_finished(started: DataFrame, outcome: DataFrame, at: Column) -> DataFrame:
    """Final event per job. `outcome`: symbol, errors array, warnings array, records_processed, records_inserted and, if known,
    records_updated, records_skipped, data_start_date, data_end_date. Without records_updated every row that was neither
    inserted nor skipped counts as an update."""
    failed = F.size("errors") > 0
    nothing = F.lit(0).cast("bigint")
    have = set(outcome.columns)
    skipped = F.col("records_skipped") if "records_skipped" in have else nothing
    updated = F.col("records_updated") if "records_updated" in have else F.col("records_processed") - F.col("records_inserted") - skipped
    period = [(F.col(c) if c in have else F.lit(None)).cast("date").alias(c) for c in ("data_start_date", "data_end_date")]
    counts = {"processed": F.col("records_processed"), "inserted": F.col("records_inserted"), "updated": updated, "skipped": skipped}
    known = outcome.select("symbol", "errors", "warnings", *[v.alias(k) for k, v in counts.items()], *period)

    def unless_failed(name: str) -> Column:
        return F.when(failed, nothing).otherwise(F.col(name)).alias(f"records_{name}")

    return started.select("job_id", "source", "symbol", "file_path").join(known, "symbol").select(
        "job_id", "source", "symbol", "file_path",
        F.when(failed, "failed").otherwise("completed").alias("status"),
        *[unless_failed(name) for name in counts],
        *[F.when(~failed, F.col(c)).alias(c) for c in ("data_start_date", "data_end_date")],
        F.when(failed, F.concat(F.lit("Validation failed: "), F.array_join("errors", "; "))).alias("error_message"),
        F.to_json(F.struct("errors", "warnings")).alias("validation_errors"),
        at.alias("at"),
    )


def current_jobs(events: DataFrame) -> DataFrame:
    rest = [c for c in JOB_FIELDS if c != "job_id"]
    return events.groupBy("job_id").agg(F.max_by(F.struct(*rest), "at").alias("state")).select("job_id", "state.*")


__all__ = [
    "BarTable", "add_sources", "current_jobs", "jobs_finished", "jobs_started", "latest_bars", "merge_bars",
    "new_keys",
]
