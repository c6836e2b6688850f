"""Lake zones: ingest, archive, inventory, retention report."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Zones of the lake and the folder of each.
ZONES = {"raw": "raw", "processed": "processed", "archived": "archive"}
RAW_FOLDERS = {"csv": "csv", "json": "json", "log": "logs"}
PROCESSED_FOLDERS = {"transformed": "transformed", "aggregated": "aggregated"}


def zone_path(root: str, zone: str, data_format: str | None = None, folder: str | None = None) -> str:
    base = f"{root}/{ZONES[zone]}" if zone in ZONES else root
    if zone == "raw" and data_format in RAW_FOLDERS:
        return f"{base}/{RAW_FOLDERS[data_format]}"
    if zone == "processed" and folder in PROCESSED_FOLDERS:
        return f"{base}/{PROCESSED_FOLDERS[folder]}"
    return base


def ingest(df: DataFrame, root: str, zone: str = "raw", dataset: str = "dataset", folder: str | None = None) -> str:
    """Write rows into a zone as Parquet, one folder per dataset column value; returns the path.

    A dataset that is there already is replaced, so a repeated job leaves the same files. Rows are gathered by dataset
    before the write (large ones are split), so there are few files.
    """
    path = zone_path(root, zone, folder=folder)
    rows = df.hint("rebalance", dataset)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(dataset).parquet(path)
    return path


def archive(df: DataFrame, root: str, name: str, at: datetime) -> str:
    """Write a time-stamped snapshot into the archive zone; returns the path."""
    path = f"{zone_path(root, 'archived')}/{name}/archived_at={at:%Y%m%d_%H%M%S}"
    df.write.parquet(path)
    return path


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, relative, length, modified of every file below `root`; file contents are never read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )
    base = root.rstrip("/")
    return files.withColumn("relative", F.regexp_extract("path", rf"^[a-z0-9]*:?/*\Q{base.lstrip('/')}\E/(.*)$", 1))


def with_zone(files: DataFrame) -> DataFrame:
    """Zone, sub-folder inside the zone ('' at its top) and extension from the relative path."""
    parts = F.split("relative", "/")
    depth = F.size(parts)
    return files.withColumns({
        "zone": F.when(depth > 1, parts[0]).otherwise(""),
        "folder": F.when(depth > 2, parts[1]).otherwise(""),
        "extension": F.lower(F.regexp_extract("relative", r"(\.[^./]+)$", 1)),
    })


def inventory(files: DataFrame) -> DataFrame:
    """Files and MB per zone by extension and by sub-folder, plus the zone totals: one aggregate over the listing."""
    mb = F.sum("length") / (1024 * 1024)
    kind = (
        F.when(F.grouping("extension") == 0, "extension").when(F.grouping("folder") == 0, "folder").otherwise("zone")
    )
    return (
        with_zone(files).select("zone", "extension", "folder", "length")
        .groupingSets([["zone", "extension"], ["zone", "folder"], ["zone"]], "zone", "extension", "folder")
        .agg(kind.alias("kind"), F.count("*").alias("files"), mb.alias("size_mb"))
        .select("zone", "kind", F.coalesce("extension", "folder", F.lit("")).alias("name"), "files", "size_mb")
        .where((F.col("kind") != "folder") | (F.col("name") != ""))
    )


def save_inventory(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def retention_report(files: DataFrame, now: str | Column, days_old: int = 30) -> DataFrame:
    """Files last modified more than `days_old` days before `now` (report only, nothing is deleted)."""
    at = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    return files.where(F.col("modified") < at - F.expr(f"INTERVAL {int(days_old)} DAYS")).select("path", "length", "modified")
