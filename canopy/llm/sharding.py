"""Reproducible shuffling into shards by a Feistel permutation of global row numbers, DataFrame functions only.

Rows get global numbers 0 to N-1 in an order that depends on their content alone: equal rows are first
counted together, then numbered by (hash, columns), in buckets of the hash that many tasks share. A keyed Feistel network over the grid a x b,
a = ceil(sqrt N) and b = ceil(N / a), permutes the numbers; a result of N or more walks its cycle until it
falls below N. The permuted number p gives shard p mod S and slot p div S, so any row's place can be
computed from its number, counts differ by one at most and slots have no gaps.

Cases: an empty table gives no rows; equal rows get neighbouring numbers and so different places; nulls
are values like others; very long texts are better hashed by the caller, as only what is passed is carried; the
columns must be groupable (no maps), and of those named shard, slot or row_number the new ones replace the old.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.common import checkpointed, unused

SHARDS = 16
ROUNDS = 6
SEED = 20240229
#: Different rows that a hash bucket has at most on average (one task sorts it), and equal ones that are numbered in one go.
BUCKET_ROWS, COPIES = 1 << 18, 1 << 16
#: Steps of cycle walking; fewer than a x b - N are ever needed, and beyond 64 the chance is below 1e-100.
WALK = 64



def permute(number: Column, total: int, seed: int = SEED) -> Column:
    """The place of a number from 0 to total - 1 in a permutation of them."""
    a = max(1, math.isqrt(max(total - 1, 0)) + 1)
    b = max(1, -(-total // a))

    def network(x: Column) -> Column:
        pair = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))

        def turn(p: Column, step: Column) -> Column:
            left = F.when(step % 2 == 0, F.pmod(p["l"] + F.pmod(F.xxhash64(p["r"], F.lit(seed), step), F.lit(a)), F.lit(a))).otherwise(p["l"])
            right = F.when(step % 2 == 1, F.pmod(p["r"] + F.pmod(F.xxhash64(p["l"], F.lit(seed), step), F.lit(b)), F.lit(b))).otherwise(p["r"])
            return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair, turn, lambda p: p["l"] * F.lit(b) + p["r"])

    once = network(number)
    steps = min(max(a * b - total, 1), WALK)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), once, lambda x, _: F.when(x < F.lit(total), x).otherwise(network(x)))
    out = F.when(once < F.lit(total), once).otherwise(walked)
    return F.when(out < F.lit(total), out).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def number_rows(df: DataFrame) -> tuple[DataFrame, int]:
    """df with row_number (0 to N-1, by the hash of the content), and N."""
    names = [c for c in df.columns if c != "row_number"]
    plain = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])  # so that no name can clash
    columns = plain.columns
    equal = checkpointed(plain.groupBy(*columns).agg(F.count("*").alias("copies")).withColumn("h", F.xxhash64(*columns)))
    bits = min(20, max(4, (max(1, equal.count()) // BUCKET_ROWS).bit_length()))
    equal = equal.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    sizes = equal.groupBy("bucket").agg(F.sum("copies").alias("size"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    begins = sizes.select("bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("begin"))
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    # the high bits of the hash are the bucket, so the order does not depend on how many there are
    inside = Window.partitionBy("bucket").orderBy("h", *columns).rowsBetween(Window.unboundedPreceding, -1)
    rows = equal.withColumn("before", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(F.broadcast(begins), "bucket")
    rows = rows.select(*columns, "copies", (F.col("begin") + F.col("before")).alias("first"))
    few = rows.where(F.col("copies") <= COPIES).select(*columns, F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)).alias("row_number"))
    blocks = F.sequence("first", F.col("first") + F.col("copies") - 1, F.lit(COPIES).cast("long"))
    many = rows.where(F.col("copies") > COPIES).select(*columns, (F.col("first") + F.col("copies")).alias("end"), F.explode(blocks).alias("low"))
    many = many.repartition("low").select(*columns, F.explode(F.sequence("low", F.least(F.col("low") + COPIES, F.col("end")) - 1)).alias("row_number"))
    numbered = few.unionByName(many)
    return numbered.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "row_number"), int(total)


def shard(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """df with row_number, shard (int) and slot (long)."""
    numbered, total = number_rows(df.drop("row_number", "shard", "slot"))
    place = unused(numbered, "place")
    placed = numbered.withColumn(place, permute(F.col("row_number"), total, seed))
    return placed.select(*numbered.columns, F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.floor(F.col(place) / shards).cast("long").alias("slot"))
