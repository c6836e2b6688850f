"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text is a vector of hashed terms of three kinds: n-grams of its shape (letters, capitals, digits, marks), n-grams of its folded bytes, and
how far back each word stood last. Terms are square roots of shares, so long and short texts compare. A truncated singular value
decomposition of the labelled sample gives DIMENSIONS latent directions; the sample's projections are broadcast (at most 2 * SAMPLE rows), and
every document is compared with all of them, a block at a time. The NEIGHBOURS of highest cosine vote with their label, weighted by
the fourth power of the cosine.

Learned from are at most SAMPLE different texts of each label, chosen by a hash of the text; labels and lang, source and doc_id are no inputs of a
score. A doc_id with both labels counts as both; labels other than 0 and 1, null ids and held-out documents teach nothing. A text without
words (null, empty, white space) gets the share of label 1 among the labelled rows, as does one without a similar neighbour;
0.5 if nothing was learned. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm.common import FOLD, staged, text_slices
from barline.llm.hashing import hashed_words
from barline.llm.language import held_out

#: Most texts of a label that are learned from.
SAMPLE = 1000
TERMS_BITS, DIMENSIONS, NEIGHBOURS = 12, 64, 15
TERMS = 1 << TERMS_BITS
#: A document of at least this score is predicted to be of label 1.
ACCEPT_FROM = 0.7
#: Documents compared at a time, and places of a text whose n-grams are hashed at a time.
BLOCK, CHUNK = 256, 1 << 20

#: Letters beyond ASCII count as small letters, white space as blanks, digits as 0.
SHAPE = bytes(
    97 if b >= 128 or 97 <= b <= 122 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))


def _places(codes: np.ndarray, salt: int) -> np.ndarray:
    return (codes * np.uint32(0x9E3779B1) + np.uint32(salt * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - TERMS_BITS)


def _gram_counts(data: np.ndarray, sizes: tuple[int, ...], salt: int) -> np.ndarray:
    counts = np.zeros(TERMS, np.int64)
    most = max(sizes)
    for at in range(0, len(data) - most + 1, CHUNK):
        part = data[at:at + CHUNK + most - 1].astype(np.uint32)
        for n in sizes:
            codes = part[:len(part) - most + 1].copy()
            for i in range(1, n):
                codes |= part[i:len(part) - most + 1 + i] << np.uint32(8 * i)
            counts += np.bincount(_places(codes, salt + n), minlength=TERMS)
    return counts


def _return_counts(words: np.ndarray) -> np.ndarray:
    """How far back the same word stood last, by powers of two (0: nowhere)."""
    order = np.argsort(words, kind="stable")
    same = words[order][1:] == words[order][:-1]
    back = np.zeros(len(words), np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    level = np.where(back > 0, np.floor(np.log2(np.maximum(back, 1))) + 1, 0).astype(np.uint32)
    return np.bincount(_places(level, 99), minlength=TERMS)


def term_vectors(texts: list[bytes | None]) -> np.ndarray:
    """A row for each text; zeros for those without words."""
    out = np.zeros((len(texts), TERMS), np.float32)
    words, bounds = hashed_words(texts, fold=False)
    for i, text in enumerate(texts):
        own = words[bounds[i]:bounds[i + 1]]
        if not len(own):
            continue
        shape, folded = (np.frombuffer(b" " + text.translate(t) + b"    ", np.uint8) for t in (SHAPE, FOLD))
        kinds = (_gram_counts(shape, (2, 4), 0), _gram_counts(folded, (3,), 10), _return_counts(own))
        out[i] = np.sqrt(sum(k / k.sum() for k in kinds))
    return out


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Neighbours:
    """projection: terms x dimensions. vectors, labels: of the sample, in the latent space. prior: score where nobody votes."""

    prior: float
    projection: np.ndarray | None = None
    vectors: np.ndarray | None = None
    labels: np.ndarray | None = None

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if self.vectors is None:
            return out
        for at in range(0, len(texts), BLOCK):
            terms = term_vectors(texts[at:at + BLOCK])
            cosines = _units(terms @ self.projection) @ self.vectors.T
            k = min(NEIGHBOURS, cosines.shape[1])
            # ties of the last place: the sample's own order
            near = np.argsort(-np.round(cosines, 6), axis=1, kind="stable")[:, :k]
            weights = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** 4
            votes, heard = (weights * self.labels[near]).sum(axis=1), weights.sum(axis=1)
            some = (heard > 0) & terms.any(axis=1)
            out[at:at + BLOCK][some] = np.clip(votes[some] / heard[some], 0, 1)
        return out


def latent_space(terms: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The leading right singular vectors, from the products of the sample's rows."""
    values, left = np.linalg.eigh(terms.astype(np.float64) @ terms.T.astype(np.float64))
    keep = np.argsort(-values)[:dimensions]
    keep = keep[values[keep] > 1e-9]
    return (terms.T @ (left[:, keep] / np.sqrt(values[keep]))).astype(np.float32)


def _key() -> Column:
    return F.md5(F.col("text").cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, float]:
    """key, quality, text of the chosen texts, and the share of label 1 among all labelled rows that may teach.

    Equal texts of a label are folded first, so copies neither crowd the sample nor meet in one task."""
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    teaching = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(
        F.col("doc_id").isNotNull() & ~held_out() & F.col("text").isNotNull())
    known = teaching.select("doc_id", _key().alias("key")).join(marks, "doc_id")
    texts = staged(known.groupBy("key", "quality").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "labelled")
    total, good = texts.agg(F.sum("n"), F.sum(F.col("n") * F.col("quality"))).first()
    chosen = None
    for value in (0, 1):
        # the hash is the draw: the key's order among the texts of a label
        own = texts.filter(F.col("quality") == value).orderBy(F.xxhash64("key"), "key").limit(sample)
        chosen = own if chosen is None else chosen.unionByName(own)
    chosen = staged(chosen.drop("n"), "chosen")
    found = teaching.join(F.broadcast(chosen), "doc_id").filter(_key() == F.col("key"))  # at most 2 * sample rows
    return found.groupBy("key", "quality").agg(F.first("text").alias("text")), (good / total if total else 0.5)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> Neighbours:
    """Fit on the documents that aren't held out."""
    found, prior = labelled_sample(docs, labels, sample)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            for at in range(0, len(texts), BLOCK):
                part, terms = rows.slice(at, BLOCK), term_vectors(texts[at:at + BLOCK])
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("quality"), pa.array([t.tobytes() for t in terms], pa.binary())], ["key", "quality", "terms"])

    taught = staged(found.mapInArrow(vectors, "key string, quality int, terms binary"), "vectors").orderBy("key", "quality").toArrow()
    if not taught.num_rows:
        return Neighbours(prior)
    terms = np.frombuffer(b"".join(taught.column("terms").to_pylist()), np.float32).reshape(-1, TERMS)
    useful = terms.any(axis=1)
    if not useful.any():
        return Neighbours(prior)
    terms, marks = terms[useful], taught.column("quality").to_numpy()[useful].astype(np.float64)
    projection = latent_space(terms, dimensions)
    return Neighbours(prior, projection, _units(terms @ projection), marks)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, accept_from: float = ACCEPT_FROM) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"]]).add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for part, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(texts), pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, schema).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= accept_from).cast("int").alias("predicted"))
