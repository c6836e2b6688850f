"""Substring deduplication with automata of repeated phrases.

Words are runs between ASCII white space, taken unchanged. A window is WINDOW consecutive words of one document. A word is
removed if a window that covers it also starts in a document with a smaller doc_id, judged on the input.

1. Texts are scanned once. Of each window the PHRASE words with the least hash are its anchor phrase; equal windows have
   equal anchors, so a window can only recur if its anchor does. Equal texts are recognised by their digest: all but those
   of the least id are removed whole, and only one of each text goes on.
2. Phrases that are anchors in two documents or more are confirmed as recurring. The first row that has one hands in its words.
3. Confirmed phrases are dealt into shards of about PATTERNS, those of a cluster of similar documents together, and each shard is compiled
   to an Aho-Corasick automaton of word codes. Documents are streamed against the automata of the shards that
   hold phrases of theirs, a bounded part of a shard's documents to a task; the automata locate every occurrence.
4. Windows around located phrases are compared by 128-bit hashes: the least doc_id owns a window, other documents lose it.

Documents of fewer than WINDOW words, and null or empty texts, lose nothing. Documents without id neither lose words nor
take any. Documents with the same id don't take words from each other. Repeated rows are judged alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm.common import staged, text_slices
from barline.llm.hashing import HIGHEST, RUN_FACTOR, SECOND_FACTOR, SPACE, hashed_words, long_run_hashes, run_hashes, sliding

WINDOW = 50
PHRASE = 8
#: A word's code: the low half of its hash.
LOW = np.uint64(2**32 - 1)
#: Phrases of an automaton, bytes of text that one task streams against it, and words that it streams at a time.
PATTERNS, STREAMED, CHUNK = 1 << 14, 8 << 20, 1 << 16


class Anchors:
    """Phrase hashes of the words of several texts, and each window's least one."""

    def __init__(self, texts: list[bytes | None], window: int, phrase: int) -> None:
        self.words, self.bounds = hashed_words(texts, fold=False)
        self.window, self.phrase, self.width = window, phrase, window - phrase + 1
        self.phrases = np.minimum(run_hashes(self.words, phrase), HIGHEST - np.uint64(1))
        sizes = np.diff(self.bounds)
        left = np.repeat(self.bounds[1:], sizes) - np.arange(len(self.words))  # words to the end of the text
        self.phrases[left[:len(self.phrases)] < phrase] = HIGHEST
        self.least = sliding(self.phrases, self.width, np.minimum)
        self.whole = left[:len(self.least)] >= window  # windows within one text

    def chosen(self) -> np.ndarray:
        """Places of phrases that are the least of a window."""
        if not self.whole.any():
            return np.zeros(0, np.int64)
        least = np.where(self.whole, self.least, np.uint64(0))
        pad = np.zeros(self.width - 1, np.uint64)
        most = sliding(np.concatenate((pad, least, pad)), self.width, np.maximum)
        return np.flatnonzero((self.phrases == most) & (self.phrases != HIGHEST))

    def by_text(self, places: np.ndarray) -> list[np.ndarray]:
        return np.split(places, np.searchsorted(places, self.bounds[1:-1])) if len(self.bounds) > 1 else []


def kept_words(text: bytes, starts: list[int], window: int) -> tuple[int, bytes]:
    """How many words the windows at `starts` cover, and the other words joined by one blank."""
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edges = np.diff(inside)
    first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    starts = np.array(starts, np.int64)
    cover = np.zeros(len(first) + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.minimum(starts + window, len(first)), -1)
    keep = np.cumsum(cover[:-1]) == 0
    first, end = first[keep], end[keep]
    # a kept word goes with the one place after it, which becomes a blank
    marks = np.zeros(len(data) + 2, np.int8)
    marks[first] += 1
    marks[end + 1] -= 1
    out = np.full(len(data) + 1, 32, np.uint8)
    out[:-1] = np.where(inside[1:-1] == 1, data, 32)
    return int(len(keep) - keep.sum()), out[np.cumsum(marks[:-1]) > 0].tobytes()[:-1]


def _digest(words: bytes) -> str:
    return hashlib.sha256(words).hexdigest()


def _text_key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _described(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """row (a number), doc_id, text_key, n_words, sha256 of all words, phrases (hashes of anchor phrases, each once)."""
    names = ["doc_id", "text_key", "n_words", "sha256", "phrases"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            anchors = Anchors(texts, window, phrase)
            lists = [np.unique(anchors.phrases[p]).view(np.int64) for p in anchors.by_text(anchors.chosen())]
            ends = np.cumsum([0] + [len(x) for x in lists]).astype(np.int32)
            values = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("text_key"), pa.array(np.diff(anchors.bounds), pa.int64()),
                 pa.array([_digest(kept_words(t or b"", [], window)[1]) for t in texts], pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key().alias("text_key")).mapInArrow(
        describe, "doc_id long, text_key binary, n_words long, sha256 string, phrases array<long>")
    return staged(rows.withColumn("row", F.monotonically_increasing_id()), "described")


def _handed_in(window: int, phrase: int):
    """Hashes and word codes of the phrases that the rows hand in, one row each."""
    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            anchors = Anchors(texts, window, phrase)
            out: list[list] = [[], []]
            for places, mine in zip(anchors.by_text(anchors.chosen()), rows.column("mine").to_pylist()):
                own, firsts = np.unique(anchors.phrases[places], return_index=True)
                asked = np.isin(own, np.array(mine, np.int64).view(np.uint64))
                codes = anchors.words[places[firsts[asked]][:, None] + np.arange(phrase)] & LOW
                out[0].append(own[asked].tobytes()), out[1].append(codes.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([rows.column("shard"), *[pa.array(c, pa.binary()) for c in out]], ["shard", "hashes", "codes"])

    return words_of


class PhraseAutomaton:
    """Aho-Corasick automaton of phrases as sequences of word codes."""

    def __init__(self, phrase: int) -> None:
        self.phrase, self.size = phrase, 0
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)

    def add(self, codes: bytes) -> None:
        for own in np.frombuffer(codes, np.uint32).reshape(-1, self.phrase).tolist():
            self.size += self.automaton.add_word(tuple(own), 1)

    def places(self, codes: np.ndarray) -> np.ndarray:
        """Where phrases begin in a text, given by its word codes."""
        if not self.size:
            return np.zeros(0, np.int64)
        if self.automaton.kind != ahocorasick.AHOCORASICK:
            self.automaton.make_automaton()
        found = []
        for at in range(0, max(len(codes) - self.phrase + 1, 0), CHUNK):
            part = tuple(codes[at:at + CHUNK + self.phrase - 1].tolist())
            found += [at + end - self.phrase + 1 for end, _ in self.automaton.iter(part)]
        return np.array(found, np.int64)


def _located(window: int, phrase: int):
    """Windows whose anchor is a phrase that the shard's automaton located. Rows come by shard and part, phrases before texts."""
    names = ["first_hash", "second_hash", "row", "doc_id", "start"]

    def windows_of(rows: pa.RecordBatch, texts: list, automaton: PhraseAutomaton, hashes: np.ndarray) -> pa.RecordBatch:
        anchors = Anchors(texts, window, phrase)
        codes = (anchors.words & LOW).astype(np.uint32)
        found = np.full(len(anchors.phrases), HIGHEST)
        places = [automaton.places(codes[a:b]) + a for a, b in zip(anchors.bounds[:-1].tolist(), anchors.bounds[1:].tolist()) if b - a >= window]
        at = np.concatenate([np.zeros(0, np.int64), *places])
        at = at[np.isin(anchors.phrases[at], hashes)]  # word codes are half of a word's hash
        found[at] = anchors.phrases[at]
        starts = np.flatnonzero((sliding(found, anchors.width, np.minimum) == anchors.least) & anchors.whole & (anchors.least != HIGHEST))
        doc = np.searchsorted(anchors.bounds, starts, "right") - 1
        one, two = (long_run_hashes(anchors.words, window, f)[starts].view(np.int64) for f in (RUN_FACTOR, SECOND_FACTOR))
        return pa.RecordBatch.from_arrays(
            [pa.array(one), pa.array(two), rows.column("row").take(pa.array(doc)), rows.column("doc_id").take(pa.array(doc)),
             pa.array((starts - anchors.bounds[doc]).astype(np.int32))], names)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton, hashes = None, None, []
        for rows, texts in text_slices(batches):
            keys = list(zip(rows.column("shard").to_pylist(), rows.column("part").to_pylist()))
            is_text, at = rows.column("text").is_valid().to_pylist(), 0
            while at < len(keys):
                if keys[at] != now:
                    now, automaton, hashes = keys[at], PhraseAutomaton(phrase), [np.zeros(0, np.uint64)]
                if not is_text[at]:
                    hashes.append(np.frombuffer(rows.column("hashes")[at].as_py(), np.uint64))
                    automaton.add(rows.column("codes")[at].as_py())
                    at += 1
                    continue
                end = at + 1
                while end < len(keys) and keys[end] == now:  # texts come last
                    end += 1
                hashes = [np.concatenate(hashes)]
                yield windows_of(rows.slice(at, end - at), texts[at:end], automaton, hashes[0])
                at = end

    return locate


class Repeats:
    """What the steps leave: described (all documents), judged (of long ones: row, first_id, first_row of their text), copies (row numbers of
    later copies of a text), candidates (first rows with recurring phrases, and their texts), starts (row number and the first words of
    the windows it loses). Repeated rows are represented by their first row."""

    def __init__(self, docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, patterns: int = PATTERNS, streamed: int = STREAMED) -> None:
        self.described = _described(docs, window, phrase)
        long_enough = self.described.filter((F.col("n_words") >= window) & F.col("doc_id").isNotNull())
        # what a hot key is joined with is written first: a join of two plain shuffles is one that Spark can split by rows
        rows = long_enough.groupBy("text_key", "doc_id").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"))
        firsts = staged(rows.groupBy("text_key").agg(F.min(F.struct("doc_id", "row", "n")).alias("f")).select(
            "text_key", F.col("f.doc_id").alias("first_id"), F.col("f.row").alias("first_row"), (F.col("f.n") > 1).alias("several")), "firsts")
        self.judged = staged(long_enough.select("row", "doc_id", "text_key", "phrases").join(firsts, "text_key").withColumn(
            "phrases", F.when(F.col("row") == F.col("first_row"), F.col("phrases"))), "judged")
        self.copies = self.judged.filter(F.col("doc_id") > F.col("first_id")).select("row")
        one_each = self.judged.filter(F.col("row") == F.col("first_row"))

        anchors = one_each.select("row", "doc_id", F.explode("phrases").alias("phrase"))
        recurring = anchors.groupBy("phrase").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("row").alias("from_row")).filter("a < b")
        recurring = staged(recurring.select("phrase", "from_row"), "recurring")
        placed = self._in_shards(staged(anchors.select("row", "phrase").join(recurring, "phrase"), "met"), recurring, patterns)
        own = F.when(F.col("from_row") == F.col("row"), F.col("phrase"))
        wanted = anchors.select("row", "phrase").join(placed, "phrase").groupBy("row").agg(
            F.collect_set("shard").alias("shards"), F.collect_list(own).alias("mine"), F.max(F.when(own.isNotNull(), F.col("shard"))).alias("own_shard"))
        wanted = staged(wanted.join(one_each.select("row", "doc_id", "text_key", "several"), "row"), "wanted")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_key", _text_key())
        # candidates are picked first; only what repeated rows bring twice is folded
        columns, key = ["doc_id", "text", "shards", "mine", "own_shard"], ["doc_id", "text_key"]
        alone = texts.join(wanted.filter("NOT several").hint("merge"), key).select("row", *columns)
        folded = texts.join(wanted.filter("several").hint("merge"), key).groupBy("row").agg(*[F.first(c).alias(c) for c in columns])
        self.candidates = staged(alone.unionByName(folded), "candidates")

        handed_in = staged(self.candidates.filter(F.size("mine") > 0).select(F.col("own_shard").alias("shard"), "mine", "text").mapInArrow(
            _handed_in(window, phrase), "shard long, hashes binary, codes binary"), "phrases")
        met = self.candidates.select("row", "doc_id", "text", F.explode("shards").alias("shard"))
        parts = staged(met.groupBy("shard").agg(F.expr(f"1 + sum(octet_length(text)) div {streamed}").alias("parts")), "parts")
        none = F.lit(None).cast("binary")
        phrases = handed_in.join(parts, "shard").select(
            "shard", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), "hashes", "codes", F.lit(None).cast("long").alias("row"),
            F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
        streams = met.join(parts, "shard").select(
            "shard", F.pmod(F.xxhash64("row"), F.col("parts")).alias("part"), none.alias("hashes"), none.alias("codes"), "row", "doc_id", "text")
        work = phrases.unionByName(streams).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("text").isNotNull())
        windows = staged(work.mapInArrow(
            _located(window, phrase), "first_hash long, second_hash long, row long, doc_id long, start int"), "windows")
        key = ["first_hash", "second_hash"]
        owners = windows.groupBy(key).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).filter("owner < last").drop("last")
        lost = windows.join(staged(owners, "owners"), key).filter(F.col("doc_id") > F.col("owner"))
        self.starts = staged(lost.groupBy("row").agg(F.sort_array(F.collect_set("start")).alias("starts")), "starts")


    @staticmethod
    def _in_shards(met: DataFrame, recurring: DataFrame, patterns: int) -> DataFrame:
        """phrase, from_row, shard. met: row, phrase, from_row.

        A row's label is the first row it shares a phrase with; phrases go by the label of the row that hands them in, so those of a cluster of near
        copies lie in one shard and a document meets few. Labels of few phrases share a shard, one of very many is cut by row."""
        labels = met.groupBy("row").agg(F.min("from_row").alias("label"))
        owned = staged(recurring.join(labels.withColumnRenamed("row", "from_row"), "from_row"), "owned")
        sizes = staged(owned.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "labels")
        common = max(1, -(-(sizes.filter(F.col("n") <= patterns).agg(F.sum("n")).first()[0] or 0) // patterns))
        cut = F.pmod(F.xxhash64("label", F.pmod(F.xxhash64("from_row"), F.expr(f"1 + (n - 1) div {patterns}"))), F.lit(1 << 40)) + common
        shard = F.when(F.col("n") <= patterns, F.pmod(F.xxhash64("label"), F.lit(common))).otherwise(cut)
        return staged(owned.join(sizes, "label").select("phrase", "from_row", shard.alias("shard")), "shards")


def removal_report(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one blank): one row per document."""
    found = Repeats(docs, window, phrase, **how)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            cut = [kept_words(t, s, window) for t, s in zip(texts, rows.column("starts").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [rows.column("row"), pa.array([n for n, _ in cut], pa.int64()), pa.array([_digest(kept) for _, kept in cut], pa.string())], ["of", "removed", "kept"])

    cut = staged(found.candidates.select("row", "text").join(found.starts, "row").mapInArrow(digest, "of long, removed long, kept string"), "cut")
    # a repeated row has the result of its text's first row
    stands = found.judged.select("row", (F.col("doc_id") > F.col("first_id")).alias("copy"), F.when(
        F.col("doc_id") == F.col("first_id"), F.col("first_row")).alias("first_row"))
    rows = found.described.drop("phrases", "text_key").join(stands, "row", "left").withColumn("of", F.coalesce("first_row", "row"))
    return rows.join(cut, "of", "left").select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept", "sha256")).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """The documents with the kept words, joined by one blank, as text where words were lost; documents of which nothing is
    left go. n_chars, if there is such a column, follows the text."""
    found = Repeats(docs, window, phrase)
    keys = found.described.select("row", F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"))
    decided = keys.join(found.starts, "row").select("_doc", "_key", F.lit(False).alias("_copy"), "starts").unionByName(
        keys.join(found.copies, "row").select("_doc", "_key", F.lit(True).alias("_copy"), F.lit(None).cast("array<int>").alias("starts")))
    decided = decided.dropDuplicates(["_doc", "_key"])
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_doc"), _text_key().alias("_key"))
    joined = packed.join(decided, ["_doc", "_key"], "left").filter(~F.coalesce("_copy", F.lit(False))).select("_row", "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches, "_row.text"):
            starts = rows.column("starts").to_pylist()
            new = [kept_words(t, s, window)[1].decode() if s else None for t, s in zip(texts, starts)]
            yield pa.RecordBatch.from_arrays([rows.column("_row"), pa.array(new, pa.string())], ["_row", "_new"])

    # _new is null where nothing was lost, and empty where nothing is left
    schema = T.StructType([joined.schema["_row"]]).add("_new", "string")
    done = joined.mapInArrow(cut, schema).filter("_new IS NULL OR _new <> ''")
    columns = {"text": F.coalesce("_new", "_row.text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.coalesce(F.char_length("_new"), F.col("_row.n_chars"))
    return done.select(*[
        columns[c].cast(docs.schema[c].dataType).alias(c) if c in columns else F.col(f"_row.`{c}`") for c in docs.columns])
