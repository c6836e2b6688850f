"""Prefix trie of conversations, rolled up by depth bands.

Every distinct sequence of first turns (role, text) is a node; conversations that start with it are its members. Prefixes are named by rolling
128-bit hashes of their turns, so a node is a group of equal hashes.

Totals over subtrees come from bands of HEIGHT depths. A node explodes only to its ancestors within its band, at most HEIGHT rows. Band roots
gather what their band holds and form a smaller trie, one depth of it for each band, which is completed in the same way; the completed
total of a band root then explodes to its ancestors in the band above. Rounds grow with the logarithm of the longest
conversation, explosion with the number of nodes.

Turns are ordered by number (null first); ties follow a digest of role and text, and repeated rows count as often as they come. Null roles and
texts are empty. Rows without conv_id take no part. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import offsets_of_parts, staged

#: Depths of a band.
HEIGHT = 8
#: Turns that are numbered and hashed by one window.
RUN = 1024
#: Turns that a conversation may take from the one it continues, and how many ids share one of these.
HEAD, FAMILY = 4, 20
KEY = ["k1", "k2"]
WORD = r"[^\x20\x09-\x0D]+"


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 1), digest, words: runs of turn numbers are sorted by themselves, however long a conversation is."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.md5(role.cast("binary")), F.md5(text.cast("binary"))).cast("binary"))
    thin = staged(turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.expr(f"CAST(coalesce(floor(turn / {RUN}), -9223372036854775808) AS BIGINT)").alias("run")), "turns")
    counts = thin.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("conv_id", "run").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return thin.join(offsets_of_parts(counts, ["conv_id"], "run", "n", "before"), ["conv_id", "run"]).select(
        "conv_id", (F.col("before") + F.row_number().over(order)).alias("position"), "digest", "words")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h turns are those of conversation c - c % FAMILY, h = crc32(c) % HEAD, before their own turns after the first h.

    (conv_id, length) of every conversation, turnless ones too, and conv_id, position, digest, words, length of their turns."""
    placed = staged(numbered_turns(turns), "numbered")
    own = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    heads = placed.filter(F.col("position") < HEAD)
    have = heads.groupBy(F.col("conv_id").alias("base")).agg(F.max("position").alias("have"))
    convs = own.select(
        "conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    taken = F.least(F.col("h"), F.coalesce("have", F.lit(0)))
    convs = staged(convs.join(have, "base", "left").select(
        "conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "rebuilt")
    tail = placed.join(convs, "conv_id").filter("position > h").select(
        "conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("position"), "digest", "words", "length")
    front = convs.filter("taken > 0").join(heads.withColumnRenamed("conv_id", "base"), "base").filter("position <= taken").select(
        "conv_id", "position", "digest", "words", "length")
    return convs.select("conv_id", "length"), front.unionByName(tail)


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, depth, k1, k2 (hash of the first `depth` turns), p1, p2 (without the last), words (of the last), length; depth 0 too."""
    e1, e2 = (F.xxhash64(F.lit(salt), "position", "digest").alias(name) for salt, name in (("one", "e1"), ("two", "e2")))
    rows = staged(turns.select("conv_id", F.expr(f"position div {RUN}").alias("run"), "position", e1, e2, "words", "length"), "hashed")
    sums = staged(rows.groupBy("conv_id", "run").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2")), "runs")
    before = offsets_of_parts(sums.select("conv_id", "run", "x1"), ["conv_id"], "run", "x1", "b1", how="bit_xor").join(
        offsets_of_parts(sums.select("conv_id", "run", "x2"), ["conv_id"], "run", "x2", "b2", how="bit_xor"), ["conv_id", "run"])
    upto = Window.partitionBy("conv_id", "run").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    k1, k2 = (F.col(f"b{i}").bitwiseXOR(F.bit_xor(f"e{i}").over(upto)) for i in (1, 2))
    hashed = rows.join(before, ["conv_id", "run"]).withColumns({"k1": k1, "k2": k2}).select(
        "conv_id", F.col("position").alias("depth"), *KEY, F.col("k1").bitwiseXOR(F.col("e1")).alias("p1"),
        F.col("k2").bitwiseXOR(F.col("e2")).alias("p2"), "words", "length")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"),
                        zero.alias("words"), "length")
    return hashed.unionByName(root)


def rolled_up(values: DataFrame, chains: DataFrame, measures: list[str], deepest: int, height: int = HEIGHT, unit: int = 1) -> DataFrame:
    """k1, k2 and the sums of the measures over the node's subtree.

    values: one row per node (k1, k2, measures), at depths divisible by `unit`. chains: conv_id, depth, k1, k2, own (whether this row
    stands for the node), so that a conversation's rows are the ancestors of the nodes it stands for."""
    at = chains.filter(F.col("depth") % unit == 0).withColumn("at", F.expr(f"depth div {unit}")).withColumn("band", F.expr(f"at div {height}"))
    # a band root also closes the band above it, where its ancestors are
    closing = at.filter((F.col("at") > 0) & (F.col("at") % height == 0)).withColumn("band", F.col("band") - 1)
    up = Window.partitionBy("conv_id", "band").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lists = at.withColumn("closing", F.lit(False)).unionByName(closing.withColumn("closing", F.lit(True))).withColumn(
        "up", F.collect_list(F.struct(*KEY)).over(up)).filter("own").select(*KEY, "closing", "up")
    lists = staged(lists, "bands")
    inside = lists.filter("NOT closing").join(values, KEY).select("up", *measures)
    sums = [F.sum(m).alias(m) for m in measures]
    shares = inside.select(F.explode("up").alias("to"), *measures)
    if deepest // unit >= height:
        roots = inside.groupBy(F.col("up")[0].alias("to")).agg(*sums).select("to.*", *measures)
        completed = rolled_up(staged(roots, "roots"), chains, measures, deepest, height, unit * height)
        across = lists.filter("closing").join(completed, KEY).select(F.explode(F.expr("slice(up, 1, size(up) - 1)")).alias("to"), *measures)
        shares = shares.unionByName(across)
    return staged(shares.select("to.*", *measures).groupBy(*KEY).agg(*sums), "totals")


def _runs_of_keys(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    keys = list(zip(*(batch.column(k).to_pylist() for k in KEY)))
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield keys[start], start, i
            start = i


def id_digests(ends: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of the ids of a key, ascending and comma-joined.

    ends: k1, k2, conv_id. Ids are sorted by range, so a key with very many takes several tasks, and joined a batch at a time; the digest,
    which has to read them in order, streams over the joined pieces and holds one at a time."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("conv_id").to_pylist()
            rows = [(*key, ids[a], ",".join(map(str, ids[a:b]))) for key, a, b in _runs_of_keys(batch)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], [*KEY, "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            done, texts = [], batch.column("ids").to_pylist()
            for key, a, b in _runs_of_keys(batch):
                if key != now:
                    if now is not None:
                        done.append((*now, running.hexdigest()))
                    now, running = key, hashlib.sha256()
                    running.update(texts[a].encode())
                    a += 1
                for text in texts[a:b]:
                    running.update(f",{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], [*KEY, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, running.hexdigest())], [*KEY, "ends_sha256"])

    joined = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(pieces, "k1 long, k2 long, first long, ids string")
    return joined.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, "k1 long, k2 long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Per node: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    convs: conv_id, length, one row per conversation; turns: conv_id, position (from 1, gapless), digest, words, length."""
    rows = staged(prefixes(convs, turns), "prefixes")
    nodes = staged(rows.groupBy("depth", *KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.max("p1").alias("p1"),
        F.max("p2").alias("p2")), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = staged(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "counted")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    values = nodes.select(*KEY, (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    stands_for = nodes.select("conv_id", "depth", F.lit(True).alias("own"))
    chains = staged(rows.select("conv_id", "depth", *KEY).join(stands_for, ["conv_id", "depth"], "left").withColumn(
        "own", F.coalesce("own", F.lit(False))), "chains")
    totals = rolled_up(values, chains, ["n_leaves", "saved_tokens"], deepest, height)
    digests = id_digests(rows.filter("depth = length").select(*KEY, "conv_id"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return nodes.join(totals, KEY).join(digests, KEY, "left").join(parents, ["p1", "p2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


def rebuilt_trie(turns: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(*rebuilt_turns(turns), height)
