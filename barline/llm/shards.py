"""Sharding by proportional stratified interleaving.

Rows are shuffled within each source by a seeded hash, ranked, and all sources are merged by fractional rank
(rank + 1/2) / rows of the source. Equal cuts of that order give shards whose counts differ by one at most (law `rows`) and
whose mixture of sources follows the corpus.

Rows with equal id, text and source are interchangeable: they are counted once and dealt out at the end. A null source is a source of its
own; null ids and texts hash as such. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import offsets_of_parts, staged, unsigned

SHARDS = 8
SEED = "42"
#: Rows that one task sorts: the number of parts follows from the number of rows.
ROWS_IN_PART = 20_000


def thin_rows(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """One row per distinct (doc_id, source, text) with its number of copies: all that sharding needs of a document."""
    text = F.coalesce("text", F.lit(""))
    missing = F.when(F.col("text").isNull(), F.lit("n")).otherwise(F.lit("t"))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), missing, F.md5(text)).cast("binary"))
    rows = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), order.alias("shuffled"))
    return rows.groupBy("doc_id", "source", "size", "text_crc32", "shuffled").agg(F.count(F.lit(1)).alias("copies"))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, rows_in_part: int = ROWS_IN_PART) -> DataFrame:
    """Columns doc_id, size, text_crc32, law, shard, slot (from 0 within the shard), grown_shard (null under this law), source.

    Ranks come from counts: a source is cut into parts by its shuffling hash, so that a source with most of the rows is
    sorted by as many tasks as its size asks for.
    """
    rows = staged(thin_rows(docs, seed).withColumn("source", F.struct("source")), "thin")
    total = rows.agg(F.sum("copies")).first()[0] or 0
    parts = max(1, -(-total // rows_in_part))

    rows = rows.withColumn("part", (unsigned(F.substring("shuffled", 1, 8)) * F.lit(parts) / F.lit(2**32)).cast("long"))
    counts = rows.groupBy("source", "part").agg(F.sum("copies").alias("n"))
    of_source = counts.groupBy("source").agg(F.sum("n").alias("n_source"))
    before = offsets_of_parts(counts, ["source"], "part", "n", "before").join(of_source, "source")
    order = Window.partitionBy("source", "part").orderBy("shuffled", "doc_id", "text_crc32", "size")
    ranked = (
        rows.join(before, ["source", "part"])
        .withColumn("first", F.col("before") + F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rank", F.explode(F.expr("sequence(first, first + copies - 1)")))
        .withColumn("fraction", (2 * F.col("rank") + 1) / (2 * F.col("n_source")))
        .withColumn("part", F.floor(F.col("fraction") * parts))
        .select("doc_id", "source", "size", "text_crc32", "rank", "fraction", "part")
    )
    start = offsets_of_parts(ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n")), [], "part", "n", "start")
    merged = Window.partitionBy("part").orderBy("fraction", "source", "rank")
    placed = ranked.join(start, "part").withColumn("place", F.col("start") + F.row_number().over(merged) - 1)
    shard = F.expr(f"place * {shards} div {max(total, 1)}")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.expr(f"place - (shard * {total}L + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("source.source").alias("source"))
