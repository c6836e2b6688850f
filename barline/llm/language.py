"""Language identification by hierarchical discrimination.

Linear support vector machines on hashed byte n-grams (2 to 4) first tell language families apart, then, within the family, each pair of
languages: one machine for each pair, the language with most votes wins (ties: the greater sum of margins, then the name).

Machines learn from at most SAMPLE labelled documents of each language, chosen by hash; prediction reads whole texts and nothing but text.
A text that is null or has no letter is `und` with score 0, and so is every text if nothing could be learned. Repeated rows are predicted alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm.common import FOLD, staged, text_slices

#: Languages by family. A language that isn't named here is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}

#: Most documents of a language that the machines learn from.
SAMPLE = 2000
DIMENSIONS = 1 << 14
#: Places of a text whose n-grams are hashed at a time.
CHUNK = 1 << 20
#: Documents with a lower score are rejected by the filter, besides those without a language.
REJECT_BELOW = 0.5
UNKNOWN = "und"

LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: bytes | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in LETTER.finditer(text.decode()))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Documents that are never learned from; those without id aren't either, but don't count as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(text: bytes) -> np.ndarray:
    """Counts of hashed byte n-grams of the folded text, scaled to length 1."""
    data = np.frombuffer(b" " + text.translate(FOLD) + b"    ", np.uint8)
    counts = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(data) - 3, CHUNK):
        part = data[at:at + CHUNK + 3].astype(np.uint32)
        gram = part[:-3] | part[1:-2] << np.uint32(8)
        for n in (2, 3, 4):
            if n > 2:
                gram = gram | part[n - 1:len(part) - 4 + n] << np.uint32(8 * (n - 1))
            place = (gram * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(18)
            counts += np.bincount(place, minlength=DIMENSIONS)
    return counts / np.sqrt(float(counts @ counts))


@dataclass
class Machines:
    """One linear machine for each pair of labels: positive margins speak for the first."""

    labels: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None
    offsets: np.ndarray | None = None

    def decide(self, x: np.ndarray) -> tuple[str, float]:
        """The label, and its least margin against another one."""
        if len(self.labels) == 1:
            return self.labels[0], np.inf
        margins = self.weights @ x + self.offsets
        n = len(self.labels)
        votes, sums, least = np.zeros(n), np.zeros(n), np.full(n, np.inf)
        for (a, b), m in zip(self.pairs, margins.tolist()):
            for label, own in ((a, m), (b, -m)):
                votes[label] += own > 0
                sums[label] += own
                least[label] = min(least[label], own)
        best = max(range(n), key=lambda i: (votes[i], sums[i], -i))
        return self.labels[best], float(least[best])


@dataclass
class LanguageModel:
    families: Machines
    languages: dict[str, Machines]

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not self.families.labels or not has_letter(text):
            return UNKNOWN, 0.0
        x = features(text)
        family, first = self.families.decide(x)
        language, second = self.languages[family].decide(x)
        return language, float(1 / (1 + np.exp(-4 * min(first, second, 50.0))))


def _one_versus_one(rows: DataFrame, label: str, labels: list[str]) -> Machines:
    from pyspark.ml.classification import LinearSVC

    made = Machines(labels)
    weights, offsets = [], []
    for a, b in combinations(range(len(labels)), 2):
        pair = rows.filter(F.col(label).isin(labels[a], labels[b])).select(
            "features", (F.col(label) == labels[a]).cast("double").alias("label"))
        machine = LinearSVC(maxIter=40, regParam=1e-4, standardization=False).fit(pair)
        made.pairs.append((a, b))
        weights.append(machine.coefficients.toArray())
        offsets.append(machine.intercept)
    if weights:
        made.weights, made.offsets = np.array(weights), np.array(offsets)
    return made


def learn(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Fit on text and lang of the documents that aren't held out."""
    from pyspark.ml.linalg import Vectors, VectorUDT

    labelled = docs.filter(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in labelled.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts.pop(UNKNOWN, None)
    if not counts:
        return LanguageModel(Machines([]), {})
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, sample / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(10**9)) / 1e9
    chosen = labelled.select(F.col("lang").cast("string").alias("lang"), "text", draw.alias("draw")).filter(F.col("draw") < share[F.col("lang")])
    names = ["lang", "at", "value"]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            out: list[list] = [[], [], []]
            for lang, text in zip(rows.column("lang").to_pylist(), texts):
                if has_letter(text):
                    x = features(text)
                    at = np.flatnonzero(x)
                    out[0].append(lang), out[1].append(at.astype(np.int32)), out[2].append(x[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64())))], names)

    vector = F.udf(lambda at, value: Vectors.sparse(DIMENSIONS, at, value), VectorUDT())
    family = F.create_map(*[F.lit(v) for lang in counts for v in (lang, FAMILY_OF.get(lang, lang))])
    # written as arrays first: the scan runs one Python process a task, and the vectors are made from the bounded sample alone
    taken = staged(chosen.mapInArrow(take, "lang string, at array<int>, value array<double>"), "sample").coalesce(2 * len(counts))
    rows = staged(taken.select("lang", family[F.col("lang")].alias("family"), vector("at", "value").alias("features")), "vectors")
    found = sorted(r.lang for r in rows.select("lang").distinct().collect())
    by_family: dict[str, list[str]] = {}
    for lang in found:
        by_family.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    return LanguageModel(
        _one_versus_one(rows, "family", sorted(by_family)), {f: _one_versus_one(rows, "lang", langs) for f, langs in by_family.items()})


def predicted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """_row (all columns of the document), lang_pred, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct("*").alias("_row"))
    schema = T.StructType([rows.schema["_row"]]).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for part, texts in text_slices(batches, "_row.text"):
            found = [own.predict(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("_row"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["_row", "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per document."""
    rows = predicted(docs.select("doc_id", "text"), learn(docs, sample))
    return rows.select("_row.doc_id", "lang_pred", "score").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, sample: int = SAMPLE, reject_below: float = REJECT_BELOW) -> DataFrame:
    """The documents with a recognised language, with their columns as they are."""
    rows = predicted(docs, learn(docs, sample))
    return rows.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= reject_below)).select("_row.*")
