"""Packing by concatenation and cutting.

First pass: documents are encoded where they lie; each partition numbers its own tokens, and its total is known. A prefix sum over
the totals gives every partition its place in one global stream. Second pass: the stream is cut every `length` tokens; each piece
records the document, the sequence and the places in both, so documents that cross a boundary can be put together again.

Only the last sequence is short (padded by its reader). A null or empty text is its end token alone. Repeated rows and
null ids are documents like others. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm.common import offsets_of_parts, staged, text_slices
from barline.llm.tokens import encode_array, tokenizer_path

LENGTH = 1024
END = 0
#: Tokens that are cut, and handed on, at a time.
SLICE_TOKENS = 1 << 20
#: Partitions whose offsets are broadcast, at 16 bytes each.
MOST_BROADCAST = 1_000_000


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, part (number of the partition), start (tokens before it in the partition), n, ids (16-bit little-endian)."""
    doc_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", doc_type)]).add("part", "long").add("start", "long").add("n", "long").add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for rows, texts in text_slices(batches):
            ids = [encode_array(t, path, np.uint16, END) for t in texts]
            n = np.array([len(x) for x in ids], np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.full(len(n), part)), pa.array(starts), pa.array(n),
                 pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "part", "start", "n", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def cut_stream(rows: DataFrame, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Pieces of encoded documents, with or without their ids; the stream's order is partition, then place in the partition."""
    totals = rows.groupBy("part").agg(F.sum("n").alias("tokens"))
    offsets = staged(offsets_of_parts(totals, [], "part", "tokens", "before"), "offsets")
    # two numbers for each partition: broadcast while that is little, so that the ids stay where they are; else joined
    offsets = F.broadcast(offsets) if offsets.count() <= MOST_BROADCAST else offsets
    placed = rows.join(offsets, "part")
    placed = placed.select("doc_id", "n", "ids", (F.col("before") + F.col("start")).alias("place"))
    schema = T.StructType([rows.schema["doc_id"]])
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(name, "long")
    schema = schema.add("ids", "binary") if with_ids else schema

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with about SLICE_TOKENS tokens at a time."""
        for batch in batches:
            part = np.cumsum(batch.column("n").to_numpy()) // SLICE_TOKENS
            bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            yield from (batch.slice(a, b - a) for a, b in zip(bounds, bounds[1:]) if b > a)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            n, place = batch.column("n").to_numpy(), batch.column("place").to_numpy()
            pieces = (place + n - 1) // length - place // length + 1
            doc = np.repeat(np.arange(len(n)), pieces)
            sequence = place[doc] // length + np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.maximum(sequence * length, place[doc])
            stop = np.minimum((sequence + 1) * length, place[doc] + n[doc])
            start = begin - place[doc]
            # 32-bit copies of one document at a time
            sums, ids, wide, last = [], [], None, -1
            texts = batch.column("ids")
            for d, a, b in zip(doc.tolist(), start.tolist(), (stop - place[doc]).tolist()):
                if d != last:
                    wide, last = np.frombuffer(texts[d].as_buffer(), np.uint16), d
                if with_ids:
                    ids.append(wide[a:b].tobytes())
                sums.append(zlib.crc32(wide[a:b].astype("<u4")))
            columns = [
                batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(stop - begin), pa.array(sums, pa.int64()), pa.array(n[doc]),
                pa.array(sequence), pa.array(begin - sequence * length), *([pa.array(ids, pa.binary())] if with_ids else [])]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])

    return placed.mapInArrow(cut, schema)


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32 (of 32-bit ids), doc_tokens, sequence_id, offset, ids (16-bit
    little-endian, so the vocabulary has to fit 16 bits)."""
    rows = staged(encoded(docs, path or tokenizer_path()), "ids")
    return cut_stream(rows, length, with_ids)
