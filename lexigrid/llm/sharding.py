"""Sharding by a hypergeometric communication matrix, native: all in DataFrame operations.

A uniform shuffle of rows into shards whose sizes differ by one at most (the law `rows`):

1. each partition counts its rows and orders them by a hash, which permutes them locally;
2. the number of rows that each partition sends to each shard is drawn from the multivariate
   hypergeometric distribution, so that shard sizes come out exactly;
3. the rows are exchanged: the first of a partition's permuted rows go to shard 0, and so on;
4. within a shard the rows are permuted again: they are dealt to sub-blocks by a hash, ordered by
   another one there, and numbered from the sub-block's offset. Slots have no gaps.

Defined cases. Null text: no bytes, CRC-32 of nothing (0). Repeated rows and equal texts are rows like
any others and get slots of their own. Fewer rows than shards: some shards are empty. An empty table
gives no rows. Null ids are hashed as empty text. Other columns pass through
whatever their names; those called size, text_crc32, shard and slot are replaced.

Scale: rows are written once (step 1) and exchanged once (step 3). The matrix has a row per partition
and a column per shard, numbers only. Nothing groups by a key of the data: neither a hot source nor
equal texts gather anywhere, as sub-blocks are dealt by a hash of the row's place as well.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigrid.llm.common import boxed, scratch, written

#: Rows a sub-block of a shard should have, for the ordering in step 4.
BLOCK_ROWS = 200_000
#: numpy draws hypergeometric counts below this many rows.
NUMPY_LIMIT = 900_000_000
PLACE_BITS = 33


def _draw(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """A hypergeometric count, by inversion from the mode where numpy's limit is passed."""
    if good == 0 or sample == 0:
        return 0
    if bad == 0:
        return sample
    if good < NUMPY_LIMIT and bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(sample, good)
    mode = min(max((sample + 1) * (good + 1) // (good + bad + 2), low), high)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(choose(good, mode) + choose(bad, sample - mode) - choose(good + bad, sample))
    u, left, right, pl, pr = rng.random() - p, mode, mode, p, p
    while u > 0 and (left > low or right < high):
        if right < high:
            pr *= (good - right) * (sample - right) / ((right + 1) * (bad - sample + right + 1))
            right += 1
            if (u := u - pr) <= 0:
                return right
        if left > low:
            pl *= left * (bad - sample + left) / ((good - left + 1) * (sample - left + 1))
            left -= 1
            if (u := u - pl) <= 0:
                return left
    return mode


def communication_matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """How many rows each partition sends to each shard; columns sum to shard sizes at most one apart."""
    rng, total = np.random.default_rng(seed), sum(sizes)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for size in sizes:
        row, rest, left = [], size, sum(room)
        for s, r in enumerate(room):
            row.append(_draw(rng, r, left - r, rest))
            rest, left = rest - row[-1], left - r
        room = [r - n for r, n in zip(room, row, strict=True)]
        matrix.append(row)
    return matrix


def _row_hash(seed: int, columns: list[Column]) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def shuffle_into_shards(docs: DataFrame, *, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` (all by default) with size, text_crc32, shard and slot."""
    spark = docs.sparkSession
    own = ("size", "text_crc32", "shard", "slot")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        boxed(docs, keep),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        _row_hash(seed, [F.col(f"`{id_col}`"), text]).alias("__key"),
    )
    # 1: permute locally; the id that Spark gives holds the partition and the row's place in it
    permuted = written(rows.sortWithinPartitions("__key").withColumn("__place", F.monotonically_increasing_id()), "shard-rows")
    partition, place = F.shiftright("__place", PLACE_BITS), F.col("__place").bitwiseAND((1 << PLACE_BITS) - 1)
    # 2: one number per partition to the driver, the matrix back
    counts = [(r["p"], r["n"]) for r in permuted.groupBy(partition.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()]
    matrix = communication_matrix([n for _, n in counts], shards, seed)
    bounds = [(p, [int(x) for x in np.cumsum(row)]) for (p, _), row in zip(counts, matrix, strict=True)]
    dealt = spark.createDataFrame(bounds, "p long, bounds array<long>")
    # 3: the shard whose range of places holds the row
    rank = F.size(F.filter("bounds", lambda b: b <= place)).cast("int")
    joined = permuted.join(F.broadcast(dealt) if len(bounds) * shards <= 4_000_000 else dealt, partition == F.col("p"))
    n_sub = max(1, math.ceil(sum(n for _, n in counts) / shards / BLOCK_ROWS))
    exchanged = joined.withColumn("shard", rank).withColumn("__sub", F.pmod(_row_hash(seed + 1, [F.col("__key"), F.col("__place")]), F.lit(n_sub)).cast("int")).drop("p", "bounds")
    # 4: permute again; offsets of sub-blocks from their counts
    blocks = exchanged.groupBy("shard", "__sub").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("shard", "__sub", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    order = Window.partitionBy("shard", "__sub").orderBy(_row_hash(seed + 2, [F.col("__key"), F.col("__place")]), "__key", "__place")
    numbered = exchanged.withColumn("__row", F.row_number().over(order))
    return numbered.join(F.broadcast(offsets) if n_sub * shards <= 1_000_000 else offsets, ["shard", "__sub"]).withColumn("slot", F.col("__offset") + F.col("__row") - 1).select("__in.*", *own)


def write_shards(sharded: DataFrame, tag: str = "shards") -> str:
    """Write a folder per shard, rows in order of their slots, to the shared folder."""
    path = scratch(sharded.sparkSession, tag)
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path
