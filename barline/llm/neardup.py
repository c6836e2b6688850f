"""N-gram Jaccard join by MinHash banding.

Documents are sets of word shingles (five lower-cased words; a text of fewer words is one shingle). Documents with equal sets form a class at
once. Of one document per class, signatures are cut into bands; documents that share a band are candidates. Bands and rows follow
from the similarity and the recall asked for. Candidates are verified on their full shingle sets:

* documents that share a band are in one group; bands of one cluster, which miss each other by a few documents, form one group, but groups don't
  chain (see band_groups);
* a pair is verified in one group, the first of those it shares (the largest, then the least number), so work follows the documents that
  share bands and not the components they chain into;
* sets travel packed with others of their group; a group is cut into blocks of bounded shingles and documents, and each pair of blocks is one
  piece of work, so no group has to fit a task and no pair leaves one;
* a piece of work counts the links of its documents and reports which of its documents hang together.

Null texts and texts without words have no shingles: they link to nothing, and each is a class of its own. Repeated rows and null ids are
documents like others; a class is named by its least id.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.common import staged, text_slices
from barline.llm.graph import components
from barline.llm.hashing import hashed_words, mixed, run_hashes

SHINGLE = 5
SIMILARITY = "0.8"
RECALL = 0.9999
HASHES = 128
#: Documents and shingles of a block, on average; two blocks are compared at a time.
BLOCK, BLOCK_SHINGLES = 800, 400_000
#: Documents and shingles whose sets are packed into one row (a document of more is alone).
PACK, PACK_SHINGLES = 64, 50_000


def bands_and_rows(similarity: float, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """Most rows in a band (fewest false candidates) for which a pair at the threshold is found with the recall asked for."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - similarity**rows) ** bands >= recall:
            return bands, rows
    raise ValueError(f"{hashes} hashes can't reach a recall of {recall} at {similarity}")


#: Some character of a word: a digit, a letter or anything beyond ASCII.
ANY_WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit("none"))


def _text_key() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, bounds = hashed_words(texts, fold=True)
    full = run_hashes(words, size)
    short = {n: run_hashes(words, n) for n in set(np.diff(bounds).tolist()) if 0 < n < size}
    return [
        np.unique(full[a:b - size + 1]) if b - a >= size else short[b - a][a:a + 1] if b > a else words[:0]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _signed(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """row (a number), doc_id, text_key, set_key (null: no shingles), size (shingles), bands (one hash each)."""
    names = ["doc_id", "text_key", "set_key", "size", "bands"]
    draw = np.random.default_rng(11)
    factors = draw.integers(0, 2**31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)
    terms = draw.integers(0, 2**32, bands * rows, np.uint32)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            sets = shingle_sets(texts, size)
            some = [i for i, s in enumerate(sets) if len(s)]
            keys: list[bytes | None] = [None] * len(sets)
            signature = np.zeros((len(some), bands), np.uint64)
            if some:
                for i in some:
                    keys[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                values = (np.concatenate([sets[i] for i in some]) >> np.uint64(32)).astype(np.uint32)
                begins = np.cumsum([0] + [len(sets[i]) for i in some[:-1]])
                room = np.empty_like(values)
                for k in range(bands * rows):
                    np.multiply(values, factors[k], out=room)
                    np.add(room, terms[k], out=room)
                    band = signature[:, k // rows]
                    band *= np.uint64(0x9E3779B97F4A7C15)
                    band += np.minimum.reduceat(room, begins)
                    if k % rows == rows - 1:
                        band[:] = mixed(band + np.uint64(k // rows + 1))
            ends = np.zeros(len(sets) + 1, np.int32)
            ends[1:] = np.cumsum([bands if k else 0 for k in keys])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_key"), pa.array(keys, pa.binary()), pa.array([len(x) for x in sets], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(signature.view(np.int64).ravel()))], names)

    signed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key().alias("text_key")).mapInArrow(
        sign, "doc_id long, text_key binary, set_key binary, size long, bands array<long>")
    return staged(signed.withColumn("row", F.monotonically_increasing_id()), "signed")


def _bundles(members: list[int], sizes: list[int]) -> Iterator[list[int]]:
    """Members in runs of at most PACK, and PACK_SHINGLES if more than one."""
    own, total = [], 0
    for i in members:
        if own and (len(own) == PACK or total + sizes[i] > PACK_SHINGLES):
            yield own
            own, total = [], 0
        own.append(i)
        total += sizes[i]
    yield own


def _packed(size: int):
    """Rows of one group that a task holds, some documents to a row: their numbers, copies, earlier groups, and sets over one list of shingles."""
    names = ["group", "blocks", "pack", "n", "data"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for part, texts in text_slices(batches):
            sets = shingle_sets(texts, size)
            sizes = [len(s) for s in sets]
            by_group: dict[int, list[int]] = {}
            blocks: dict[int, int] = {}
            earlier: dict[tuple[int, int], list[int]] = {}
            for i, groups in enumerate(part.column("groups").to_pylist()):
                for k, g in enumerate(groups):
                    by_group.setdefault(g["group"], []).append(i)
                    blocks[g["group"]] = g["blocks"]
                    earlier[g["group"], i] = [x["group"] for x in groups[:k]]
            rows, copies = part.column("row").to_numpy(), part.column("copies").to_numpy()
            out: list[list] = [[], [], [], [], []]
            for group, members in by_group.items():
                for bundle in _bundles(members, sizes):
                    own = np.array(bundle)
                    before = [np.array(earlier[group, i], np.int64) for i in bundle]
                    shingles, codes = np.unique(np.concatenate([sets[i] for i in bundle]), return_inverse=True)
                    counts = np.array([(sizes[i], len(b)) for i, b in zip(bundle, before)], np.int64).T.ravel()
                    data = np.concatenate([rows[own], copies[own], counts, *before]).tobytes()
                    data += shingles.tobytes() + codes.astype(np.uint32).tobytes()
                    for column, value in zip(out, (group, blocks[group], (task << 32) + made, len(own), zlib.compress(data, 1))):
                        column.append(value)
                    made += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names)

    return pack


def _unpack(n: int, data: bytes):
    """Row numbers, copies, sizes, numbers of earlier groups, these groups, shingles."""
    raw = zlib.decompress(data)
    rows, copies, sizes, counts = np.frombuffer(raw, np.int64, 4 * n).reshape(4, n)
    total, listed = int(sizes.sum()), int(counts.sum())
    codes = np.frombuffer(raw[len(raw) - 4 * total:], np.uint32)
    groups = np.frombuffer(raw, np.int64, listed, 32 * n)
    return rows, copies, sizes, counts, groups, np.frombuffer(raw[32 * n + 8 * listed:len(raw) - 4 * total], np.uint64)[codes]


def common_counts(doc: np.ndarray, shingle: np.ndarray, left: int, n: int) -> np.ndarray:
    """How many shingles document i < left and document j >= left have in common (left == n: all with all).
    doc, shingle: one entry per element of a set."""
    code, count = np.unique(shingle, return_inverse=True, return_counts=True)[1:]
    rows, columns = (n, n) if left == n else (left, n - left)
    order = np.argsort(code, kind="stable")
    order = order[count[code[order]] > 1]
    doc, code = doc[order], code[order]
    counted = count[code]
    common = np.zeros((rows, columns), np.float32)
    # shingles of few documents: their pairs, one distance within the sorted run at a time
    few = counted <= 16
    d, c = doc[few], code[few]
    pairs = np.zeros(rows * columns, np.int64)
    for step in range(1, 16):
        if len(d) <= step:
            break
        same = c[step:] == c[:-step]
        a, b = d[:-step][same], d[step:][same]
        a, b = np.minimum(a, b), np.maximum(a, b)
        if left < n:
            across = (a < left) & (b >= left)
            a, b = a[across], b[across] - left
        pairs += np.bincount(a * columns + b, minlength=rows * columns)
    pairs = pairs.reshape(rows, columns)
    common += pairs if left < n else pairs + pairs.T
    # shingles of many: dense products over some columns at a time
    d, c = doc[~few], np.unique(code[~few], return_inverse=True)[1]
    for low in range(0, int(c.max(initial=-1)) + 1, 2048):
        part = (c >= low) & (c < low + 2048)
        dense = np.zeros((n, 2048), np.float32)
        dense[d[part], c[part] - low] = 1
        common += dense[:rows] @ (dense.T if left == n else dense[left:].T)
    return common


def _hanging_together(linked: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each document, the least row number it is connected with. linked: symmetric."""
    root = np.full(len(rows), -1, np.int64)
    for i in np.argsort(rows):
        if root[i] >= 0:
            continue
        root[i] = rows[i]
        front = np.array([i])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
            root[front] = rows[i]
    return root


def verify(packs: list[tuple[int, int, bytes]], similarity: Fraction):
    """packs: (side, n, data). Row numbers with links, their links (documents), the least row they are connected with. Pairs that share an
    earlier group are left to it."""
    sides, parts = [], []
    for side, n, data in sorted(packs, key=lambda p: p[0]):
        sides.append(np.full(n, side))
        parts.append(_unpack(n, data))
    side = np.concatenate(sides)
    row, copy, size, counts, groups, shingles = map(np.concatenate, zip(*parts))
    one_side = side[0] == side[-1]
    left = len(row) if one_side else int((side == side[0]).sum())
    open_pairs = common_counts(np.repeat(np.arange(len(row)), counts), groups, left, len(row)) == 0
    if one_side:
        np.fill_diagonal(open_pairs, False)
        needed = open_pairs.any(axis=1)
    else:
        needed = np.concatenate((open_pairs.any(axis=1), open_pairs.any(axis=0)))
    doc = np.repeat(np.arange(len(row)), size)
    looked_at = needed[doc]
    common = common_counts(doc[looked_at], shingles[looked_at], left, len(row)).astype(np.int64)
    a, b = (size, size) if one_side else (size[:left], size[left:])
    up, down = similarity.numerator, similarity.denominator
    linked = (common * (up + down) >= up * (a[:, None] + b[None, :])) & open_pairs
    if one_side:
        links, both = linked @ copy, linked
    else:
        links = np.concatenate((linked @ copy[left:], linked.T @ copy[:left]))
        both = np.zeros((len(row), len(row)), bool)
        both[:left, left:], both[left:, :left] = linked, linked.T
    some = np.flatnonzero(links)
    return row[some], links[some], _hanging_together(both[np.ix_(some, some)], row[some])


def _verified(similarity: Fraction):
    names = ["row", "links", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are sorted by (group, i, j): a piece of work ends where these change."""
        key, packs, seen, done = None, [], set(), []

        def flush():
            if packs and (key[1] == key[2] or len({p[0] for p in packs}) == 2):  # a block may have got no packs
                done.append(verify(packs, similarity))

        def out():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*done)], names)

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("group", "i", "j")))
            owns, packed, sizes = (batch.column(c).to_pylist() for c in ("own", "pack", "n"))
            for at, own in enumerate(keys):
                if own != key:
                    flush()
                    key, packs, seen = own, [], set()
                if packed[at] not in seen:
                    seen.add(packed[at])
                    packs.append((owns[at], sizes[at], batch.column("data")[at].as_py()))
            if done:
                yield out()
                done.clear()
        flush()
        if done:
            yield out()

    return run


def band_groups(members: DataFrame, block: int, block_shingles: int) -> DataFrame:
    """row, group, documents, blocks: the groups in which pairs are verified. members: row, band, size.

    Bands of the same documents are folded to one. A row's first band is its largest. A band joins the group that is named by the first band of
    most of its rows: bands of one cluster of near copies, which miss each other by a few rows, are one group, and a band that merely touches
    a cluster adds its rows to it and no rows of theirs, so groups don't chain. All rows of a band are in its group."""
    ties = members.groupBy("band").agg(
        F.count(F.lit(1)).alias("documents"), F.min("row").alias("least"), F.max("row").alias("most"),
        F.bit_xor(F.xxhash64("row")).alias("who")).filter("documents > 1")
    once = staged(ties.groupBy("documents", "least", "most", "who").agg(F.min("band").alias("band")), "bands")
    # joins of two plain shuffles: Spark splits a band that very many share
    placed = staged(members.join(once.select("band", "documents"), "band").select("row", "size", "band", "documents"), "placed")
    first = placed.groupBy("row").agg(F.min(F.struct((-F.col("documents")).alias("fewer"), "band"))["band"].alias("first"))
    ranked = staged(placed.join(staged(first, "first"), "row").select("row", "size", "band", "first"), "ranked")
    counted = ranked.groupBy("band", "first").agg(F.count(F.lit(1)).alias("n"))
    named = staged(counted.groupBy("band").agg(F.max(F.struct("n", "first"))["first"].alias("group")), "named")
    grouped = staged(ranked.select("row", "size", "band").join(named, "band").groupBy("row", "group").agg(F.max("size").alias("size")), "grouped")
    blocks = F.expr(f"greatest((documents + {block - 1}) div {block}, (shingles + {block_shingles - 1}) div {block_shingles})")
    sizes = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("documents"), F.sum("size").alias("shingles"))
    return staged(grouped.join(staged(sizes, "sizes"), "group").select("row", "group", "documents", blocks.alias("blocks")), "groups")


def jaccard_join(
    docs: DataFrame, similarity: str = SIMILARITY, shingle: int = SHINGLE, recall: float = RECALL, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """row, doc_id, text_key, class_row (least row number of the class), n_links (other documents at or above the similarity): one row per document."""
    least = Fraction(similarity)
    bands, rows = bands_and_rows(float(least), recall)
    signed = _signed(docs, shingle, bands, rows)
    usable = signed.filter(F.col("set_key").isNotNull())
    classes = staged(usable.groupBy("set_key").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies")), "classes")

    members = signed.join(classes.select("row"), "row").select("row", "size", F.explode("bands").alias("band"))
    grouped = band_groups(members, block, block_shingles)
    # the first of the groups that a pair shares is the same for both of its rows
    listed = grouped.groupBy("row").agg(F.sort_array(F.collect_list(F.struct((-F.col("documents")).alias("fewer"), "group", "blocks"))).alias("groups"))
    wanted = listed.join(classes, "row").join(signed.select("row", _id(F.col("doc_id")).alias("_id"), "text_key"), "row").select(
        "_id", "text_key", "row", "copies", "groups")
    texts = docs.filter(F.col("text").isNotNull()).select(_id(F.col("doc_id").cast("long")).alias("_id"), _text_key().alias("text_key"), "text")
    # candidates are few: they are picked first (by a merge join at any size), and what repeated rows bring twice is folded among them
    picked = texts.join(staged(wanted, "wanted").hint("merge"), ["_id", "text_key"]).groupBy("row").agg(
        F.first("text").alias("text"), F.first("copies").alias("copies"), F.first("groups").alias("groups"))
    packs = staged(picked.mapInArrow(_packed(shingle), "group long, blocks long, pack long, n int, data binary"), "packs")

    work = packs.withColumn("own", F.pmod(F.xxhash64("pack"), F.col("blocks"))).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    work = work.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "pack", "n", "data")
    # ranges deal pieces of work out evenly, where hashes would heap some up; sorting keeps the packs of a piece together
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = work.repartitionByRange(parts, "group", "i", "j").sortWithinPartitions("group", "i", "j")
    found = staged(work.mapInArrow(_verified(least), "row long, links long, root long"), "links")

    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("row").alias("a"), F.col("root").alias("b")), "classes")
    decided = classes.join(links, "row", "left").join(roots.withColumnRenamed("node", "row"), "row", "left").select(
        "set_key", F.coalesce("root", "row").alias("class_row"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    decided = staged(decided, "decided")  # copies of one text may be a third of all rows: Spark splits a join of plain shuffles
    return signed.drop("bands", "size").join(decided, "set_key", "left").select(
        "row", "doc_id", "text_key", F.coalesce("class_row", "row").alias("class_row"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def duplicate_classes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id (least id of the documents connected by links), n_links: one row per document."""
    joined = staged(jaccard_join(docs, **how), "joined")
    names = staged(joined.groupBy("class_row").agg(F.min("doc_id").alias("class_id")), "names")
    return joined.join(names, "class_row").select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One document of each class, the one of least id (a row without id only if all are), with its columns as they are.
    Documents without words are classes of their own, so all of them stay.

    Kept keys pick their rows; only keys that stand in several rows are folded after it (both joins read one shuffle of the rows).
    """
    joined = jaccard_join(docs, **how)
    alike = joined.groupBy("class_row", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n")).alias("best")
    kept = alike.groupBy("class_row").agg(least).select(
        _id(F.col("best.doc_id")).alias("_id"), F.col("best.text_key").alias("_key"), (F.col("best.n") > 1).alias("_several"))
    kept = staged(kept.filter(F.col("_key").isNotNull()), "kept")
    rows = docs.select(
        F.struct("*").alias("_row"), _id(F.col("doc_id").cast("long")).alias("_id"), _text_key().alias("_key"),
        F.coalesce(F.col("text").rlike(ANY_WORD), F.lit(False)).alias("_words"))
    worded, key = rows.filter("_words"), ["_id", "_key"]
    alone = worded.join(kept.filter("NOT _several").hint("merge"), key).select("_row.*")
    folded = worded.join(kept.filter("_several").hint("merge"), key).groupBy(*key).agg(F.first("_row").alias("_row")).select("_row.*")
    return alone.unionByName(folded).unionByName(rows.filter("NOT _words").select("_row.*"))
