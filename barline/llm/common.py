"""What several operators share: normalised words, bounded text batches, prefix sums over ordered parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.sources.scratch import stage

#: UTF-8 bytes of text that are taken apart at a time inside a task; longer texts are taken alone.
SLICE_BYTES = 1 << 19

#: Lower-cases A-Z, keeps digits, letters and bytes of other alphabets, turns every other byte into a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def folded_words(text: bytes) -> list[bytes]:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a UTF-8 text."""
    return text.translate(FOLD).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write below spark.checkpoint.dir and read back: lineage ends here, so a lost executor repeats little."""
    return stage(df, f"llm-{name}")


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of rows with at most SLICE_BYTES of text each, beside their texts as UTF-8 bytes (None: null).
    The column may be a field of a struct: "_row.text"."""
    top, _, inner = column.partition(".")
    for batch in batches:
        values = pc.struct_field(batch.column(top), inner) if inner else batch.column(top)
        values = values.cast(pa.large_binary())
        sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
        start = size = 0
        for i, own in enumerate([*sizes, SLICE_BYTES + 1]):
            if i > start and (size + own > SLICE_BYTES):
                yield batch.slice(start, i - start), values.slice(start, i - start).to_pylist()
                start, size = i, 0
            size += own


def flat(lists: list[list]) -> tuple[list, np.ndarray]:
    """Concatenated lists, and the place where each begins (with the end as the last)."""
    bounds = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=bounds[1:])
    return [x for part in lists for x in part], bounds


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in schema)], schema=schema)


def offsets_of_parts(totals: DataFrame, keys: list[str], order: str, value: str, out: str, run: int = 4096, how: str = "sum") -> DataFrame:
    """`value` gathered over the earlier parts of the same keys, as column `out` (0 before the first): how is sum, bit_xor or
    max. No task sorts more than `run` parts of one key, or one row for each run.

    totals: one row per keys and `order` (a long). Parts are gathered in runs of `run` consecutive numbers; what the runs
    have is scanned, and each run is scanned by itself.
    """
    gather = {"sum": F.sum, "bit_xor": F.bit_xor, "max": F.max}[how]
    both = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b), "max": F.greatest}[how]
    nothing = F.lit(0).cast("long")
    group = [F.col(k) for k in keys]
    in_runs = totals.withColumn("_run", F.expr(f"floor(`{order}` / {run})"))
    runs = in_runs.groupBy(*group, "_run").agg(gather(value).alias("_sum"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_base", F.coalesce(gather("_sum").over(before), nothing)).drop("_sum")
    inside = Window.partitionBy(*group, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        in_runs.join(runs, [*keys, "_run"])
        .withColumn(out, both(F.col("_base"), F.coalesce(gather(value).over(inside), nothing)))
        .drop("_run", "_base", value)
    )


def unsigned(hex_digits: Column) -> Column:
    """Number of up to 8 hexadecimal digits."""
    return F.conv(hex_digits, 16, 10).cast("long")
