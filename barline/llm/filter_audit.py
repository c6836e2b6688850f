"""Interaction audit of quality filters, with a counting-Bloom prepass for exact duplicates.

What a text fails depends on the text alone, but for "is a copy of an earlier document", which needs the whole table. Tasks count the
digests of their texts in sketches of saturating counters; the merged sketch clears every text that shares no full set of cells with
another one. Only what may repeat is shuffled, by its full text, for the least id of equal texts. Each document is then a mask of
failed filters, and the audit of every order of the filters follows from counts per part and mask, which add up.

The sketch has CELLS_PER_TEXT cells for each row, up to MOST_CELLS, so that what is broadcast (one bit a cell) is bounded by 32 MB. Beyond that
many rows fewer texts are cleared and more are shuffled; the result stays exact. Null texts are empty. A null id is no smaller id and has none. Rows of one id and text aren't copies
of each other. Labels of one doc_id count if any of its rows says 1. Parts are languages; a null one joins the empty one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import staged

FILTERS = "ABCDE"
#: Counters per row of the table, most counters of a sketch, counters of a block, counters that a text touches.
CELLS_PER_TEXT, MOST_CELLS, BLOCK, PROBES = 8, 1 << 28, 1 << 20, 3
#: Texts whose counters a task gathers before it hands them on.
GATHERED = 1 << 18
COPY = 1 << FILTERS.index("E")


def text_failures(text: Column) -> Column:
    """Mask of what the text alone fails: too few words, too few distinct words, too many capitals, markup characters."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))[0]
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = F.transform(F.array(counts), lambda c: (
        F.when(c["n"] < 200, 1).otherwise(0) + F.when(100 * c["distinct"].cast("long") < 50 * c["n"].cast("long"), 2).otherwise(0)))[0]
    return (fails + F.when(100 * capitals.cast("long") > 3 * F.length(text).cast("long"), 4).otherwise(0)
            + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)).cast("int")


def text_digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def cells_of(digests: list[bytes], cells: int) -> np.ndarray:
    """PROBES cells of each digest (rows), distinct or not."""
    halves = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    step = halves[:, 1] | np.uint64(1)
    return np.stack([(halves[:, 0] + np.uint64(i) * step) & np.uint64(cells - 1) for i in range(PROBES)], axis=1).astype(np.int64)


def _counted(found: list[np.ndarray], cells: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(block, cells, whether counted once or more often) of the gathered cells, each text counting once in a cell."""
    cell, n = np.unique(np.concatenate(found), return_counts=True)
    for block in np.unique(cell // BLOCK).tolist():
        own = (cell >= block * BLOCK) & (cell < (block + 1) * BLOCK)
        yield block, (cell[own] % BLOCK).astype(np.uint32).tobytes(), np.packbits(n[own] > 1).tobytes()


def repeat_sketch(docs: DataFrame, cells: int) -> np.ndarray:
    """One bit for each cell: counted more than once over all texts. Blocks are merged where they meet, one at a time."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0

        def out():
            rows = list(_counted(found, cells))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], ["block", "cells", "twice"])

        for batch in batches:
            digests = batch.column("digest").to_pylist()
            if digests:
                probes = np.sort(cells_of(digests, cells), axis=1)  # a text that hits a cell twice counts once
                fresh = np.ones(probes.shape, bool)
                fresh[:, 1:] = probes[:, 1:] != probes[:, :-1]
                found.append(probes[fresh])
                held += len(digests)
            if held >= GATHERED:
                yield out()
                found, held = [], 0
        if found:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, twice = None, None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["block", "bits"])

        for batch in batches:
            for block, cell, more in zip(*(batch.column(c).to_pylist() for c in ("block", "cells", "twice"))):
                if block != now:
                    if now is not None:
                        yield out()
                    now, seen, twice = block, np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)
                cell = np.frombuffer(cell, np.uint32)
                twice[cell] |= seen[cell] | np.unpackbits(np.frombuffer(more, np.uint8), count=len(cell)).astype(bool)
                seen[cell] = True
        if now is not None:
            yield out()

    partial = docs.select(text_digest(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest")).mapInArrow(
        count, "block long, cells binary, twice binary")
    merged = partial.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, bits binary")
    bits = np.zeros(max(cells, BLOCK) // 8, np.uint8)
    for row in merged.toLocalIterator():  # one bit a cell: 32 MB at most
        bits[row.block * BLOCK // 8:(row.block + 1) * BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    return bits


def masks(docs: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """doc_id, part, mask, weight: failed filters of every document. Copies come as corrections (weight -1 without, 1 with the copy's bit)."""
    rows = docs.count()
    cells = min(most_cells, max(BLOCK, 1 << max(rows * CELLS_PER_TEXT - 1, 1).bit_length()))
    sketch = docs.sparkSession.sparkContext.broadcast(repeat_sketch(docs, cells))

    @F.pandas_udf("boolean")
    def may_repeat(digests: pd.Series) -> pd.Series:
        probes = cells_of(digests.tolist(), cells)
        bits = sketch.value[probes >> 3] >> (7 - (probes & 7)).astype(np.uint8) & 1
        return pd.Series(bits.all(axis=1))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    judged = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"),
        text_digest(text).alias("digest")).select("doc_id", "part", text_failures(F.col("text")).alias("mask"), "text", may_repeat("digest").alias("again"))
    judged = staged(judged.select("doc_id", "part", "mask", "again", F.when(F.col("again"), F.col("text")).alias("text")), "judged")
    candidates = judged.filter("again AND doc_id IS NOT NULL").select("doc_id", "part", "mask", "text")
    first = candidates.groupBy("text").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("text", "first")
    copies = candidates.join(staged(first, "first"), "text").filter("doc_id > first").groupBy("doc_id", "part", "mask").agg(
        F.count(F.lit(1)).alias("n"))
    copies = staged(copies, "copies")
    every = judged.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("weight"))
    return every.unionByName(copies.select("doc_id", "part", "mask", (-F.col("n")).alias("weight"))).unionByName(
        copies.select("doc_id", "part", (F.col("mask") + COPY).alias("mask"), F.col("n").alias("weight")))


def mask_counts(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents that fail exactly these filters."""
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("long")).alias("good"),
        F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("long")).alias("toxic"))
    weigh = lambda c: F.sum(F.col("weight") * F.coalesce(c, F.lit(0)))
    return masked.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("weight").alias("n"), weigh("good").alias("good"), weigh("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, filters: str = FILTERS, most_cells: int = MOST_CELLS) -> DataFrame:
    """part, filter_order, step and the document counts of the step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, and shapley
    (documents its filter removes, summed over all orders): one row per part, order and step."""
    bit = {f: 1 << i for i, f in enumerate(filters)}
    orders = ["".join(p) for p in permutations(filters)]
    steps = [(o, i + 1, sum(bit[f] for f in o[:i]), bit[f]) for o in orders for i, f in enumerate(o)]
    step = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("filter_order", "step", "earlier", "own"), s)]) for s in steps]))
    counts = staged(mask_counts(masks(docs, most_cells), labels), "masks")
    rows = counts.select("part", "mask", "n", "good", "toxic", step.alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    passed, fails = F.col("mask").bitwiseAND(F.col("earlier")) == 0, F.col("mask").bitwiseAND(F.col("own")) != 0
    total = lambda where, what="n": F.sum(F.when(where, F.col(what)).otherwise(0)).cast("long")
    # of the orders, a document that fails m filters meets each of these first in one m-th
    share = F.expr(f"n * CAST({len(orders)} div greatest(bit_count(mask), 1) AS BIGINT)")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(passed & ~fails).alias("kept"), total(passed & fails).alias("removed"), total(fails & ~passed).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"), total(passed & fails, "good").alias("good_lost"),
        total(passed & fails, "toxic").alias("toxic_lost"), F.sum(F.when(fails, share).otherwise(0)).cast("long").alias("shapley"))
