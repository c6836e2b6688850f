"""Benchmark decontamination: a broadcast hash set of benchmark windows, looked up at every word of the corpus.

Words are lower-cased (A-Z) runs of digits, letters and non-ASCII characters. A window is `width` consecutive words of an
item; an item of fewer words is one window. Items without words (or without text) have no window. Repeated items
and items that share windows are all reported. An item without id contaminates, and is listed as "null".

Documents without text, or without words, have no hits and pass. Repeated documents are judged each by itself. Texts are read
whole whatever their length. Other columns of the documents are carried along untouched, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm.common import batch_of, flat, folded_words, staged, text_slices

WORDS_IN_WINDOW = 10
#: Windows held by a task at once, in bytes of their words. A larger benchmark is looked up in several passes.
BROADCAST_BYTES = 32 << 20

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
HITS = "n_words long, hits array<struct<start:int,length:int>>, items array<string>, spans array<struct<start:int,stop:int>>"


def benchmark_windows(benchmark: DataFrame, width: int = WORDS_IN_WINDOW) -> DataFrame:
    """One row per distinct window (words joined by a space) and item: window binary, n int, item string."""
    schema = pa.schema([("window", pa.binary()), ("n", pa.int32()), ("item", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            out = [], [], []
            for item, text in zip(rows.column("item").to_pylist(), texts):
                words = folded_words(text or b"")
                for i in range(max(len(words) - width, 0) + 1 if words else 0):
                    part = words[i:i + width]
                    out[0].append(b" ".join(part))
                    out[1].append(len(part))
                    out[2].append(item)
            yield batch_of(schema, window=out[0], n=out[1], item=out[2])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    return items.mapInArrow(cut, "window binary, n int, item string").distinct()


class WindowSet:
    """Windows by their words, with what finds them fast: numbers of their words and sums over these by length."""

    def __init__(self, rows: list) -> None:
        self.items: dict[bytes, list[str]] = {}
        by_length: dict[int, list[bytes]] = {}
        for row in rows:
            window = bytes(row.window)
            if window not in self.items:
                by_length.setdefault(row.n, []).append(window)
            self.items.setdefault(window, []).append(row.item)
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for x in self.items for w in x.split(b" ")}), 1)}
        numbers = np.random.default_rng(7)
        self.numbers = numbers.integers(0, 2**63, len(self.vocabulary) + 1, np.uint64)
        self.factors = numbers.integers(0, 2**63, max(by_length, default=1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.sums = {
            n: np.unique(self._sum(np.array([[self.vocabulary[w] for w in x.split(b" ")] for x in windows])))
            for n, windows in by_length.items()
        }

    def _sum(self, words: np.ndarray) -> np.ndarray:
        return (self.numbers[words] * self.factors[:words.shape[1]]).sum(axis=1, dtype=np.uint64)

    def find(self, texts: list[list[bytes]]) -> list[list[tuple[int, int, bytes]]]:
        """Of each text: start, length and words of every occurrence of a window."""
        words, bounds = flat(texts)
        found: list[list[tuple[int, int, bytes]]] = [[] for _ in texts]
        known = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        seen = np.concatenate(([0], np.cumsum(known > 0)))
        for n, sums in self.sums.items():
            if len(words) < n:
                continue
            starts = np.flatnonzero(seen[n:] - seen[:-n] == n)
            for part in np.array_split(starts, len(starts) // 100_000 + 1):
                hit = self._sum(known[part[:, None] + np.arange(n)])
                place = np.minimum(np.searchsorted(sums, hit), len(sums) - 1)
                part = part[sums[place] == hit]
                for at, doc in zip(part.tolist(), (np.searchsorted(bounds, part, "right") - 1).tolist()):
                    window = b" ".join(words[at:at + n])
                    if at + n <= bounds[doc + 1] and window in self.items:
                        found[doc].append((at - int(bounds[doc]), n, window))
        return found


def _byte_spans(text: bytes, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges from the first to the last word of overlapping hits."""
    places = [m.span() for m in WORD.finditer(text)]
    spans: list[list[int]] = []
    for start, n in sorted(hits):
        if spans and start < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], start + n)
        else:
            spans.append([start, start + n])
    return [(places[a][0], places[b - 1][1]) for a, b in spans]


def _passes(benchmark: DataFrame, width: int, most: int) -> Iterator[list]:
    """Rows of the windows, at most about `most` bytes at a time."""
    windows = staged(benchmark_windows(benchmark, width), "windows")
    size = windows.agg(F.sum(F.octet_length("window") + F.octet_length("item"))).first()[0] or 0
    blocks = -(-size // most) or 1
    for i in range(blocks):
        yield windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == i).collect()


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = WORDS_IN_WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Beside `_row` (all columns of the document): n_words, hits (first word and length of each occurrence),
    items (ids of the items with occurring windows, as sorted strings), spans (byte ranges of the text).

    The set of windows is broadcast whole if it stays below `broadcast_bytes`; else it is cut into blocks by hash
    and the documents pass by each block in turn, written in between.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("_row"))
    previous: DataFrame | None = None
    for windows in _passes(benchmark, width, broadcast_bytes):
        held = spark.sparkContext.broadcast(windows)
        source = rows if previous is None else staged(previous, "hits")
        first = previous is None
        schema = T.StructType([
            source.schema["_row"], *T.StructType.fromDDL(HITS).fields])

        def scan(batches: Iterator[pa.RecordBatch], held=held, first=first) -> Iterator[pa.RecordBatch]:
            windows = WindowSet(held.value)
            for part, texts in text_slices(batches, "_row.text"):
                words = [folded_words(t) if t else [] for t in texts]
                hits, items, spans = [], [], []
                old = [([], [])] * len(texts) if first else [
                    ([(h["start"], h["length"]) for h in a], b)
                    for a, b in zip(part.column("hits").to_pylist(), part.column("items").to_pylist())]
                for text, found, (had, had_items) in zip(texts, windows.find(words), old):
                    own = sorted({(a, n) for a, n, _ in found} | set(had))
                    hits.append([{"start": a, "length": n} for a, n in own])
                    items.append(sorted({i for _, _, w in found for i in windows.items[w]} | set(had_items)))
                    spans.append([{"start": a, "stop": b} for a, b in _byte_spans(text, own)] if own else [])
                span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
                hit = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), pa.array([len(w) for w in words], pa.int64()),
                     pa.array(hits, hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, span)],
                    ["_row", "n_words", "hits", "items", "spans"])

        previous = source.mapInArrow(scan, schema)
    return previous


def hit_words(hits: str = "hits") -> str:
    """SQL for the number of words inside any of the hits (sorted by their first word)."""
    return (f"aggregate({hits}, named_struct('n', 0L, 'upto', 0), (s, h) -> named_struct('n', s.n + greatest(h.start + h.length - "
            "greatest(h.start, s.upto), 0), 'upto', greatest(s.upto, h.start + h.length)), s -> s.n)")


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "documents", **how) -> DataFrame:
    """The documents without what the benchmark has: action "documents" drops each document with a hit, "spans" cuts
    the hit words (and what stands between them) out of its text. The columns stay as they are."""
    if action not in ("documents", "spans"):
        raise ValueError(f"action is documents or spans, not {action}")
    found = find_hits(docs, benchmark, **how)
    if action == "documents":
        return found.filter(F.size("hits") == 0).select("_row.*")
    cut = ("decode(aggregate(spans, named_struct('out', CAST('' AS BINARY), 'at', 0), (s, x) -> named_struct('out', s.out || "
           "substring(CAST(_row.text AS BINARY), s.at + 1, x.start - s.at), 'at', x.stop), s -> s.out || "
           "substring(CAST(_row.text AS BINARY), s.at + 1)), 'UTF-8')")
    text = F.when(F.size("spans") == 0, F.col("_row.text")).otherwise(F.expr(cut))
    return found.select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])


def contamination(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per document."""
    found = find_hits(docs.select("doc_id", "text"), benchmark, **how)
    return found.select(
        "_row.doc_id", "n_words", F.expr(hit_words()).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
