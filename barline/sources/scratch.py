"""Where intermediate tables go: the shared folder the cluster names in spark.checkpoint.dir. Local sessions may do without: theirs is the warehouse."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Write options where tasks leave a file in each of many folders. On a local disk, Hadoop's checksummed file system starts `chmod` for each folder, file
#: and checksum where its native library is absent; the plain one does without checksums. Other file systems are not affected.
MANY_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):  # by default the warehouse is a folder of the driver's machine
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        named = spark.conf.get("spark.sql.warehouse.dir")
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/barline/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write and read back: cuts the lineage, survives executor loss, keeps column pruning and file statistics."""
    path = fresh_path(df.sparkSession, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
