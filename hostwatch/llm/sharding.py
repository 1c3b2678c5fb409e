"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Every row gets a global number 0..n-1 (rows in the order of a digest of the row, so the number depends on the data
alone, not on partitions or retries). A keyed Feistel permutation of Z_a x Z_b with a = ceil(sqrt n), b = ceil(n / a)
moves it to its position; positions of n or more walk on along their cycle until they fall below n. Fewer than a
values lie outside, so a walk is rare and short. Position p lies in shard p mod S at slot p div S: both can be
computed from (number, n, seed) without a lookup, and ``number_at`` goes back. Shard counts are at most one apart.

Equal rows are counted before numbers are dealt and spread again after it, so no group of copies meets in one task.
Null cells are values like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The Mersenne prime of the round function and its multipliers.
PRIME = 2147483647
MULTIPLIERS = (48271, 69621, 16807)
DOUBLE_ROUNDS = 3
WALK = 64
COPIES_PER_ROW = 4096


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def round_keys(seed: int) -> list[tuple[int, int]]:
    keys, x = [], (seed * 2654435761 + 12345) % PRIME
    for _ in range(DOUBLE_ROUNDS):
        pair = []
        for m in MULTIPLIERS[:2]:
            x = (x * m + 11) % PRIME
            pair.append(x)
        keys.append(tuple(pair))
    return keys


def mix(value: Column, key: Column) -> Column:
    """((v + k) mod P) * ((v * m + k) mod P) mod P, within 64 bits for v below 2^47 / m."""
    return (((value + key) % PRIME) * ((value * MULTIPLIERS[2] + key) % PRIME)) % PRIME


def permute(x: Column, n: int, seed: int, back: bool = False) -> Column:
    """One pass of the permutation of 0..a*b-1 (or of its inverse)."""
    a, b = sides(n)
    keys = round_keys(seed)

    def forth_step(s, k):
        left = (s["l"] + mix(s["r"], k["a"])) % a
        return F.struct(left.alias("l"), ((s["r"] + mix(left, k["b"])) % b).alias("r"))

    def back_step(s, k):
        right = F.pmod(s["r"] - mix(s["l"], k["b"]), F.lit(b))
        return F.struct(F.pmod(s["l"] - mix(right, k["a"]), F.lit(a)).alias("l"), right.alias("r"))

    rounds = F.array(*[F.struct(F.lit(p).cast("long").alias("a"), F.lit(q).cast("long").alias("b"))
                       for p, q in (reversed(keys) if back else keys)])
    start = F.struct(common.div(x, b).alias("l"), (x % b).cast("long").alias("r"))
    return F.aggregate(rounds, start, back_step if back else forth_step, lambda s: s["l"] * b + s["r"])


def walked(x: Column, n: int, seed: int, back: bool = False) -> Column:
    """Permute, and again while the value lies outside 0..n-1. Raises rather than return such a value."""
    steps = F.sequence(F.lit(1), F.lit(WALK))
    first = permute(x, n, seed, back)
    far = F.aggregate(steps, first, lambda p, _: F.when(p < n, p).otherwise(permute(p, n, seed, back)),
                      lambda p: F.when(p < n, p).otherwise(F.raise_error(F.lit("walk too long; take another seed"))))
    return F.when(first < n, first).otherwise(far)


def position_of(number: Column, n: int, seed: int) -> Column:
    return walked(number, n, seed)


def number_at(shard: Column, slot: Column, n: int, shards: int, seed: int) -> Column:
    """The row number that lies in this shard at this slot."""
    return walked(slot * shards + shard, n, seed, back=True)


def shard_rows(df: DataFrame, shards: int = 16, seed: int = 1, identity: Column | None = None,
               rows_per_chunk: int = 8192) -> DataFrame:
    """Add ``row_no``, ``position``, ``shard`` and ``slot`` to every row.

    ``identity`` is the string whose digest orders the rows (default: all columns as JSON). Columns of those names
    give way. Rows are grouped by all columns, so columns must be of groupable types.
    """
    names = df.columns
    if identity is None:
        identity = F.to_json(F.struct(*names)) if names else F.lit("")
    rows = common.staged(df.withColumn("_order", F.md5(F.encode(identity, "utf-8"))).groupBy(*names, "_order")
                         .agg(F.count(F.lit(1)).alias("_copies")), "shard-rows")
    total = rows.agg(F.sum("_copies"), F.count(F.lit(1))).first()
    n, distinct = total[0] or 0, total[1]
    chunks = max(16, -(-distinct // rows_per_chunk))
    chunk = common.div(F.conv(F.substring("_order", 1, 7), 16, 10).cast("long") * chunks, 1 << 28)
    rows = rows.withColumn("_chunk", chunk)
    starts = common.before(rows.groupBy("_chunk").agg(F.sum("_copies").alias("_rows")), [], "_chunk", "_rows", "_start")
    inside = (Window.partitionBy("_chunk").orderBy("_order", *[F.col(c) for c in names])
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_before", F.coalesce(F.sum("_copies").over(inside), F.lit(0))).join(
        common.small(starts.select("_chunk", "_start")), "_chunk")
    rows = rows.withColumn("_first", F.col("_start") + F.col("_before"))
    # copies of one row: first into blocks, then each block into rows
    blocks = rows.withColumn("_block", F.explode(F.sequence(
        F.lit(0).cast("long"), common.div(F.col("_copies") - 1, COPIES_PER_ROW))))
    if n > distinct:
        blocks = blocks.repartition("_order", "_block")
    low = F.col("_block") * COPIES_PER_ROW
    out = blocks.withColumn("row_no_", F.explode(F.sequence(
        F.col("_first") + low, F.col("_first") + F.least(low + COPIES_PER_ROW, F.col("_copies")) - 1)))
    out = out.withColumn("position_", position_of(F.col("row_no_"), max(n, 1), seed))
    kept = [c for c in names if c not in ("row_no", "position", "shard", "slot")]
    return out.select(*kept, F.col("row_no_").alias("row_no"), F.col("position_").alias("position"),
                      (F.col("position_") % shards).cast("int").alias("shard"),
                      common.div(F.col("position_"), shards).alias("slot"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law ``rows``: shard counts at most one apart."""
    text = F.encode(common.text_of(), "utf-8")
    rows = common.documents(spark, sf_dir).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"))
    identity = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                           F.col("size").cast("string"), F.col("text_crc32").cast("string"))
    out = shard_rows(rows, 16, seed=20_240_601, identity=identity)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "row_no")
