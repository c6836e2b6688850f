"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation again and again, each time with more turns. Rolling hashes over the turns name every prefix; a conversation
whose whole is a proper prefix of another one goes, and of equal ones the least id stays. What is left is rendered.

Turns are ordered by number, role and text. Null roles and texts are values of their own (rendered as empty), repeated turns
count as often as they come. A turn without conversation id is a conversation of one turn. Hashes have 128 bits. A very
long conversation is numbered and hashed in runs of turns; only its rendering is one row, as it has to be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import offsets_of_parts, staged

#: Turn numbers of a run.
RUN = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PREFIX = ["position", "p1", "p2"]


def turn_digest() -> Column:
    """Of role and text, null apart from empty."""
    part = [F.coalesce(F.concat(F.lit("v"), F.md5(F.col(c).cast("binary"))), F.lit("n")) for c in ("role", "text")]
    return F.md5(F.concat(*part).cast("binary"))


def _links(position: Column) -> list[Column]:
    return [F.xxhash64(F.lit(salt), position.cast("long"), F.col("digest")) for salt in ("one", "two")]


def hashed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 1), e1, e2 (hash of the turn at its place), p1, p2 (of all turns up to it)."""
    thin = turns.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), turn_digest().alias("digest"),
        F.expr(f"CAST(coalesce(floor(turn / {RUN}), -9223372036854775808) AS BIGINT)").alias("run"))
    thin = staged(thin, "turns")
    counts = thin.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("conv_id", "run").orderBy("turn", "role", "digest")
    placed = thin.join(offsets_of_parts(counts, ["conv_id"], "run", "n", "before"), ["conv_id", "run"]).withColumn(
        "position", F.col("before") + F.row_number().over(order))
    e1, e2 = _links(F.col("position"))
    placed = staged(placed.select("conv_id", "run", "position", e1.alias("e1"), e2.alias("e2")), "placed")
    whole = placed.groupBy("conv_id", "run").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    before = offsets_of_parts(whole.select("conv_id", "run", "x1"), ["conv_id"], "run", "x1", "b1", how="bit_xor").join(
        offsets_of_parts(whole.select("conv_id", "run", "x2"), ["conv_id"], "run", "x2", "b2", how="bit_xor"), ["conv_id", "run"])
    upto = Window.partitionBy("conv_id", "run").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(before, ["conv_id", "run"]).select(
        "conv_id", "position", "e1", "e2", F.col("b1").bitwiseXOR(F.bit_xor("e1").over(upto)).alias("p1"),
        F.col("b2").bitwiseXOR(F.bit_xor("e2").over(upto)).alias("p2"))


def rendered_turn() -> Column:
    """One turn in ChatML; marks of the format inside a text are broken up."""
    plain = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"<\|im_", "< |im_") for c in ("role", "text")]
    return F.concat(F.lit(OPEN), plain[0], F.lit("\n"), plain[1], F.lit(CLOSE + "\n"))


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, text: one row per maximal conversation."""
    hashed = staged(hashed_turns(turns), "prefixes")
    alone = turns.filter(F.col("conv_id").isNull()).withColumn("digest", turn_digest())
    e1, e2 = _links(F.lit(1))
    alone = alone.groupBy(F.lit(1).cast("long").alias("position"), e1.alias("p1"), e2.alias("p2")).agg(
        F.first(rendered_turn()).alias("text"))

    ends = hashed.groupBy("conv_id").agg(F.max(F.struct(*PREFIX)).alias("end")).select("conv_id", "end.*")
    one_each = ends.groupBy(*PREFIX).agg(F.min("conv_id").alias("conv_id"))
    # what stands before a turn is a prefix that someone continued
    continued = hashed.filter("position > 1").select(
        (F.col("position") - 1).alias("position"), F.col("p1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("p2").bitwiseXOR(F.col("e2")).alias("p2")).distinct()
    maximal = one_each.join(continued, PREFIX, "left_anti").select("conv_id")
    lone = alone.join(continued, PREFIX, "left_anti").join(one_each, PREFIX, "left_anti")

    order = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), turn_digest().alias("digest"), rendered_turn().alias("text"))
    texts = turns.select("conv_id", order.alias("t")).join(maximal, "conv_id", "left_semi")
    rendered = texts.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")).select(
        "conv_id", F.size("ts").cast("long").alias("n_turns"), F.array_join("ts.text", "").alias("text"))
    return rendered.unionByName(lone.select(
        F.lit(None).cast(turns.schema["conv_id"].dataType).alias("conv_id"), F.lit(1).cast("long").alias("n_turns"), "text"))
