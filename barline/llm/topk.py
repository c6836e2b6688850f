"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are grouped into buckets of similar length, longest first. A query's k-th score so far, divided by its own length
and the greatest length of a bucket, is the cosine that a vector of this bucket must reach. Above 1 the bucket is skipped; else
length pruning cuts it to the prefix of vectors that are long enough, and, where the threshold is high, coordinate pruning
keeps only vectors whose component along the query's largest coordinate allows that cosine. What stays is multiplied out exactly.

Components are floor(64 x) as whole numbers, so scores are exact; ties go to the smaller id. Rows without id, and vectors that are
null or hold null or non-finite components, take no part. Vectors are only compared with those of as many components. Every row with the
query's id is the query's own; other rows count as often as they come (k copies of a row are all that any query can need). An
empty table gives no rows.

Vectors whose squared length reaches 2^62 could overflow whole numbers of 64 bits. Pairs with such a vector go another exact way: extended
floats bound each score, and what may be among the best is multiplied out in Python's integers. Ranks follow the exact scores; a score
beyond 64 bits is given as the nearest 64-bit number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import offsets_of_parts, staged

K = 20
#: Candidates of a bucket and queries of a block: together they bound what a task multiplies at a time.
BUCKET = 8192
BLOCK = 512
#: Coordinate pruning pays from this cosine on; below, products are cheaper than looking.
COORDINATE_FROM = 0.6
#: Sums of products below this stay whole numbers in doubles.
EXACT = 2**53

SCORES = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def usable_vectors(vectors: DataFrame, id_column: str, vector_column: str, scale: int, k: int) -> DataFrame:
    """id, x (components), dims, huge, copy (from 1, at most k of equal rows), of the usable rows."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("x"))
    usable = rows.filter(
        F.col("id").isNotNull() & F.col("x").isNotNull()
        & F.expr("forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))"))
    size = F.expr(f"aggregate(x, 0D, (s, c) -> s + (abs(c * {float(scale)}D) + 1) * (abs(c * {float(scale)}D) + 1))")
    folded = usable.groupBy("id", "x").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("copies"))
    return folded.select(
        "id", "x", F.size("x").alias("dims"), (size >= float(2**62)).alias("huge"), F.explode(F.expr("sequence(1L, copies)")).alias("copy"))


def whole_vectors(usable: DataFrame, scale: int) -> DataFrame:
    """id, copy, v (array of whole numbers as long), dims, norm2, of the vectors that aren't huge."""
    return usable.filter("NOT huge").select(
        "id", "copy", F.expr(f"transform(x, c -> CAST(floor(c * {float(scale)}D) AS BIGINT))").alias("v"), "dims").withColumn(
        "norm2", F.expr("aggregate(v, CAST(0 AS BIGINT), (s, c) -> s + c * c)"))


def _matrix(data: bytes, dims: int) -> np.ndarray:
    flat = np.frombuffer(data, np.int64)
    return flat.reshape(-1, dims) if dims else flat.reshape(0, 0)


def _pack(rows: DataFrame, key: str, order: list) -> DataFrame:
    """One row per dims and block: ids and components as bytes of 64-bit numbers, in the given order."""
    schema = pa.schema([("dims", pa.int32()), (key, pa.int64()), ("ids", pa.binary()), ("data", pa.binary()), ("longest", pa.float64())])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        ids = table.column("id").to_numpy().astype(np.int64)
        data = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        longest = float(np.sqrt(max(table.column("norm2").to_pylist())))
        return pa.table({"dims": [table.column("dims")[0].as_py()], key: [table.column(key)[0].as_py()], "ids": [ids.tobytes()],
                         "data": [data.tobytes()], "longest": [longest]}, schema=schema)

    return rows.groupBy("dims", key).applyInArrow(pack, f"dims int, {key} long, ids binary, data binary, longest double")


def _products(queries: np.ndarray, vectors: np.ndarray, exact_in_doubles: bool) -> np.ndarray:
    if exact_in_doubles:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


def search_bucket(query_ids, queries, floors, ids, vectors, k: int):
    """Per query, at most k candidates of one bucket (vectors longest first) with a score of its floor or more."""
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    own = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    exact = len(lengths) > 0 and bool(own.max(initial=0) * lengths.max() < EXACT / 4)
    out = []
    cosine = np.where(floors > 0, floors * (1 - 1e-9) / np.maximum(own * lengths.max(initial=0), 1e-300), -1.0)
    # length pruning: shorter vectors than floor / |q| can't reach the floor
    prefix = np.where(floors > 0, np.searchsorted(-lengths, -(floors * (1 - 1e-9) / np.maximum(own, 1e-300)), "right"), len(lengths))
    dense = np.flatnonzero((cosine <= 1) & (cosine < COORDINATE_FROM) & (prefix > 0))
    scores = _products(queries[dense], vectors[:prefix[dense].max(initial=0)], exact) if len(dense) else None
    units = vectors / np.maximum(lengths, 1e-300)[:, None] if np.any(cosine >= COORDINATE_FROM) else None
    at = dict(zip(dense.tolist(), range(len(dense))))
    for i in np.flatnonzero((cosine <= 1) & (prefix > 0)).tolist():
        if i in at:
            rows, score = np.arange(prefix[i]), scores[at[i], :prefix[i]]
        else:
            # coordinate pruning: cos >= t bounds each coordinate to u t -/+ sqrt((1 - u^2)(1 - t^2))
            f = int(np.abs(queries[i]).argmax())
            u, t = queries[i, f] / own[i], min(max(cosine[i], 0.0), 1.0)
            slack = np.sqrt(max((1 - u * u) * (1 - t * t), 0.0)) + 1e-6
            column = units[:prefix[i], f]
            lower = -1.0 if u < -t else u * t - slack
            upper = 1.0 if u > t else u * t + slack
            rows = np.flatnonzero((column >= lower) & (column <= upper))
            score = _products(queries[i:i + 1], vectors[rows], exact)[0]
        keep = np.flatnonzero((score >= floors[i]) & (ids[rows] != query_ids[i]))
        rows, score = rows[keep], score[keep]
        if len(rows) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            keep = np.flatnonzero(score >= least)
            keep = keep[np.lexsort((ids[rows[keep]], -score[keep]))][:k]
            rows, score = rows[keep], score[keep]
        out.append((np.full(len(rows), query_ids[i]), ids[rows], score))
    return [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else ((), (), ()))]


LOWEST = -(2**63)


def _search(k: int):
    """One block of queries against one bucket."""
    def search(pairs: pa.Table) -> pa.Table:
        out = []
        for row in pairs.to_pylist():  # one row, or as many as repeat a pair: none
            query_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
            if row["dims"]:
                queries, vectors = _matrix(row["q_data"], row["dims"]), _matrix(row["data"], row["dims"])
            else:  # products of vectors without components are 0
                queries, vectors = np.zeros((len(query_ids), 1), np.int64), np.zeros((len(ids), 1), np.int64)
            floors = np.frombuffer(row["floors"], np.int64) if row["floors"] else np.full(len(query_ids), LOWEST)
            out.append(search_bucket(query_ids, queries, floors, ids, vectors, k))
        return pa.table([np.concatenate(c) for c in zip(*out)], schema=SCORES)
    return search


def _top(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _in_buckets(rows: DataFrame, bucket: int) -> DataFrame:
    """Adds `bucket`: rows are cut into ranges of length, longest first, and each range is dealt by id and copy over buckets of
    about `bucket` rows, so that a range with very many equal lengths takes several."""
    ranges = min(256, -(-rows.count() // bucket))
    cuts = rows.approxQuantile("norm2", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    part = sum((F.when(F.col("norm2") <= c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0)).cast("long")
    rows = rows.withColumn("part", part)
    sizes = rows.groupBy("dims", "part").agg(F.expr(f"(count(1) + {bucket - 1}) div {bucket}").alias("n"))
    sizes = sizes.join(offsets_of_parts(sizes, ["dims"], "part", "n", "base"), ["dims", "part"])
    return rows.join(sizes, ["dims", "part"]).withColumn("bucket", F.col("base") + F.pmod(F.xxhash64("id", "copy"), F.col("n"))).drop("part", "n", "base")


def whole_numbers(x: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of finite doubles of any size; scale is a power of two."""
    return [int(np.floor(c * scale)) if abs(c) < 2.0**900 else int(c) * scale for c in x.tolist()]


def best_exactly(query: list[int], own_id: int, ids: np.ndarray, vectors: list[list[int]], k: int) -> list[tuple[int, int]]:
    """(vec_id, score) of the k best rows other than the query's own."""
    wide = np.array(vectors, object).astype(np.longdouble).reshape(len(vectors), -1)
    q = np.array(query, object).astype(np.longdouble)
    about = wide @ q
    # each product and sum is off by a relative 2^-63 at most
    off = (np.abs(wide) @ np.abs(q)) * np.longdouble(2.0**-60) * (len(query) + 2)
    others = np.flatnonzero(ids != own_id)
    if len(others) > k:
        least = np.sort((about - off)[others])[-k]
        others = others[(about + off)[others] >= least]
    scored = sorted((-sum(a * b for a, b in zip(query, vectors[i])), int(ids[i])) for i in others.tolist())
    return [(i, -s) for s, i in scored[:k]]


def order_key(score: int) -> str:
    """Sorts as the number does, whatever its size."""
    digits = str(abs(score))
    key = f"{len(digits):04d}{digits}"
    return "1" + key if score >= 0 else "0" + key.translate(str.maketrans("0123456789", "9876543210")) + "~"


def _huge_scores(usable: DataFrame, every: int, k: int, scale: int, bucket: int, block: int) -> DataFrame:
    """query_id, vec_id, score, key of pairs of which one vector is huge: blocks of queries against blocks of rows."""
    def packed(rows: DataFrame, per_block: int, names: tuple[str, str, str]) -> DataFrame:
        blocks = max(1, -(-rows.count() // per_block))
        number, ids, data = names

        def pack(table: pa.Table) -> pa.Table:
            return pa.table({
                "dims": [table.column("dims")[0].as_py()], "huge": [table.column("huge")[0].as_py()], number: [table.column(number)[0].as_py()],
                ids: [table.column("id").to_numpy().astype(np.int64).tobytes()],
                data: [table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).tobytes()]},
                schema=pa.schema([("dims", pa.int32()), ("huge", pa.bool_()), (number, pa.int64()), (ids, pa.binary()), (data, pa.binary())]))

        numbered = rows.withColumn(number, F.pmod(F.xxhash64("id", "copy"), F.lit(blocks)))
        return staged(numbered.groupBy("dims", "huge", number).applyInArrow(pack, f"dims int, huge boolean, {number} long, {ids} binary, {data} binary"), number)

    queries = packed(usable.filter((F.col("id") % every == 0) & (F.col("copy") == 1)), block, ("block", "q_ids", "q_data"))
    rows = packed(usable, bucket, ("bucket", "ids", "data"))
    asked = queries.select("dims", "block", F.col("huge").alias("q_huge"), "q_ids", "q_data")
    pairs = asked.join(rows, "dims").filter("q_huge OR huge").repartition("dims", "q_huge", "block", "huge", "bucket")
    names = ["query_id", "vec_id", "score", "key"]

    def search(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in ("dims", "q_ids", "q_data", "ids", "data")}
                q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                split = lambda d, n: [whole_numbers(x, scale) for x in np.frombuffer(d, np.float64).reshape(n, -1)]
                vectors, out = split(row["data"], len(ids)), []
                for own, query in zip(q_ids.tolist(), split(row["q_data"], len(q_ids))):
                    out += [(own, i, max(-(2**63), min(2**63 - 1, s)), order_key(s)) for i, s in best_exactly(query, own, ids, vectors, k)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names)

    return pairs.mapInArrow(search, "query_id long, vec_id long, score long, key string")


def top_inner_products(
    vectors: DataFrame, every: int = 20, k: int = K, scale: int = 64, id_column: str = "vec_id", vector_column: str = "embedding",
    bucket: int = BUCKET, block: int = BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by `every`, its k highest products with other rows.

    The bucket of longest vectors is searched first; each query's k-th score there is the floor for all other buckets, which are searched
    in parallel: a task holds one block of queries and one bucket. A bucket too short for every query of a block isn't sent to it. Only scores at or
    above the floor leave a task, at most k for each query. Several different vectors of one query id are searched each, and ranked together.
    """
    usable = staged(usable_vectors(vectors, id_column, vector_column, scale, k), "vectors")
    rows = staged(_in_buckets(staged(whole_vectors(usable, scale), "whole"), bucket), "bucketed")
    buckets = staged(_pack(rows, "bucket", [("norm2", "descending"), ("id", "ascending")]), "buckets")
    queries = rows.filter((F.col("id") % every == 0) & (F.col("copy") == 1))
    blocks = max(1, -(-queries.count() // block))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    packed = staged(_pack(queries, "block", [("id", "ascending")]).select(
        "dims", "block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data")), "queries")

    def search(pairs: DataFrame) -> DataFrame:
        """pairs: dims, block, bucket, floors. Blocks and buckets join it by their numbers."""
        full = pairs.join(packed, ["dims", "block"]).join(buckets.drop("longest"), ["dims", "bucket"])
        return full.groupBy("dims", "bucket", "block").applyInArrow(_search(k), "query_id long, vec_id long, score long")

    one = packed.select("dims", "block", F.lit(0).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("floors"))
    found = staged(search(one), "first")
    floors = _top(found, k).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))

    def order_floors(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])
        floor = pc.fill_null(table.column("floor"), LOWEST).to_numpy().astype(np.int64)
        own = np.sqrt(table.column("norm2").to_numpy().astype(np.float64))
        # the least length with which a vector can reach some query's floor
        needs = float(np.where(floor > 0, floor * (1 - 1e-9) / np.maximum(own, 1e-300), 0.0).min())
        return pa.table({"dims": [table.column("dims")[0].as_py()], "block": [table.column("block")[0].as_py()], "floors": [floor.tobytes()], "needs": [needs]},
                        schema=pa.schema([("dims", pa.int32()), ("block", pa.int64()), ("floors", pa.binary()), ("needs", pa.float64())]))

    by_block = queries.join(floors, "id", "left").select("dims", "block", "id", "norm2", "floor").groupBy("dims", "block").applyInArrow(
        order_floors, "dims int, block long, floors binary, needs double")
    later = by_block.join(buckets.select("dims", "bucket", "longest"), "dims").filter("bucket > 0 AND longest >= needs")
    rest = search(later.select("dims", "block", "bucket", "floors"))
    scores = found.unionByName(rest)
    order = Window.partitionBy("query_id")
    if usable.filter("huge").isEmpty():
        ranked = scores.withColumn("rank", F.row_number().over(order.orderBy(F.desc("score"), "vec_id")))
    else:
        digits = F.abs("score").cast("string")
        size = F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)
        keys = F.when(F.col("score") >= 0, F.concat(F.lit("1"), size)).otherwise(  # as order_key
            F.concat(F.lit("0"), F.translate(size, "0123456789", "9876543210"), F.lit("~")))
        both = scores.withColumn("key", keys).unionByName(_huge_scores(usable, every, k, scale, min(bucket, 1024), min(block, 64)))
        ranked = both.withColumn("rank", F.row_number().over(order.orderBy(F.desc("key"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
