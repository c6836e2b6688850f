"""Token counts of flat token files by separator scan.

A flat file is nothing but 16-bit little-endian ids; a document ends with the id SEPARATOR, and no index says where. Files are read in
blocks of BLOCK tokens. Each block is searched at once for separators; a prefix scan over the blocks tells every block how many documents
ended before it and where the last one did, which stitches documents that cross blocks.

Tokens after the last separator of a file are a document too, marked as not ended. Two separators in a row hold a document of 0 tokens. An
empty file has no documents. A file is read whole by one task before it is cut (at most 2 GiB, as Spark's binary files), but no
task holds more than a run of its blocks afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.common import offsets_of_parts, staged, text_slices
from barline.llm.tokens import encode_array, tokenizer_path
from barline.sources.scratch import fresh_path

SEPARATOR = 0
BLOCK = 1 << 20


def write_flat(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Flat token files, one for each partition of the documents, in its order: ids of the tokenizer plus 1, and the separator 0
    after each document. A null text is a document of 0 tokens.

    Rows are written as they are, with the separator's two bytes as the writer's line end.
    """
    vocabulary = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches):
            ids = [encode_array(t, vocabulary, np.uint16, SEPARATOR, shift=1)[:-1].tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    docs.select("text").mapInArrow(run, "ids binary").select(F.col("ids").cast("string")).write.option("lineSep", "\x00\x00").text(path)


def flat_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """file (its name), block (from 0), n_blocks, tokens (bytes of at most `block` ids) of all files in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).filter("length > 0")
    last = f"(length + {2 * block - 1}) div {2 * block} - 1"
    pieces = F.expr(f"transform(sequence(0L, {last}), i -> struct(i AS block, {last} + 1 AS n_blocks, "
                    f"substring(content, CAST(i * {2 * block} + 1 AS INT), {2 * block}) AS tokens))")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.explode(pieces).alias("b")).select("file", "b.*")


def count_tokens(blocks: DataFrame, block: int = BLOCK, separator: int = SEPARATOR) -> DataFrame:
    """file, doc_index (from 0 in the file), start (its first token in the file), n_tokens (without the separator), ended."""
    names = ["file", "block", "last_block", "n", "ends"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(t.as_buffer(), np.uint16) for t in batch.column("tokens")]
            ends = [np.flatnonzero(x == separator) for x in ids]
            bounds = np.cumsum([0] + [len(e) for e in ends]).astype(np.int32)
            at = np.repeat(batch.column("block").to_numpy() * block, np.diff(bounds)) + np.concatenate([*ends, np.zeros(0, np.int64)])
            last = batch.column("block").to_numpy() == batch.column("n_blocks").to_numpy() - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(last), pa.array([len(x) for x in ids], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(bounds), pa.array(at.astype(np.int64)))], names)

    scanned = staged(blocks.mapInArrow(search, "file string, block long, last_block boolean, n long, ends array<long>"), "separators")
    keys = ["file", "block"]
    counts = scanned.select(*keys, F.size("ends").cast("long").alias("v"))
    latest = scanned.select(*keys, F.coalesce(F.try_element_at("ends", F.lit(-1)) + 1, F.lit(0)).alias("v"))  # the token after it; 0: none yet
    state = offsets_of_parts(counts, ["file"], "block", "v", "docs").join(offsets_of_parts(latest, ["file"], "block", "v", "begin", how="max"), keys)
    stitched = scanned.join(state, keys)
    ended = stitched.select("file", "docs", "begin", "ends", F.posexplode("ends").alias("k", "end")).select(
        "file", (F.col("docs") + F.col("k")).alias("doc_index"),
        F.expr("IF(k = 0, begin, ends[k - 1] + 1)").alias("start"), "end", F.lit(True).alias("ended"))
    rest = stitched.filter("last_block").select(
        "file", (F.col("docs") + F.size("ends")).alias("doc_index"), F.coalesce(F.try_element_at("ends", F.lit(-1)) + 1, "begin").alias("start"),
        (F.col("block") * block + F.col("n")).alias("end"), F.lit(False).alias("ended")).filter("end > start")
    return ended.unionByName(rest).select("file", "doc_index", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "ended")


def corpus_token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The documents written as flat files and counted from these alone; files are named by their partition."""
    path = fresh_path(docs.sparkSession, "llm-flat")
    write_flat(docs, path, tokenizer)
    counted = count_tokens(flat_blocks(docs.sparkSession, path))
    return counted.withColumn("file", F.regexp_extract("file", "^(part-[0-9]+)", 1))
