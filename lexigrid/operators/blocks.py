"""All pairs in blocks that are kept as they are finished, so that a run that was stopped goes on where it was.

Items are dealt to blocks by a hash of their ids, which is the same in every run. A pair of blocks is
one group, multiplied by tiles of bounded size, whose pairs leave the task as they are found; a round runs some of them, writes their pairs in a folder for each,
and then notes them in a manifest. A run takes the pairs of blocks that the manifest lacks. What a stopped round
has left is overwritten, as its folders are those of the same blocks, so no pair is there twice.

The manifest also holds a mark of the items: other items, blocks or thresholds under the same folder are refused.
Null vectors, and vectors of zeros, are in no pair. Equal ids are one item of the caller's making; none is dropped.
An empty table has no pairs, and is finished at once.

Scale: a round moves the items of its own blocks only, and the manifest has a row per pair of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lexigrid.operators import tiles

PAIRS = "a long, b long, score double"
NOTED = "i int, j int, mark long, pairs long"
#: Pairs of blocks in a round.
AT_ONCE = 256


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(i, j, mark, pairs) of the finished pairs of blocks."""
    path = f"{folder}/manifest"
    return spark.read.schema(NOTED).parquet(path) if _exists(spark, path) else spark.createDataFrame([], NOTED)


def pending(spark: SparkSession, folder: str, blocks: int) -> DataFrame:
    """(i, j) of the pairs of blocks that are still to do, i <= j."""
    grid = spark.range(blocks).select(F.col("id").cast("int").alias("i")).withColumn("j", F.explode(F.sequence("i", F.lit(blocks - 1))))
    return grid.join(manifest(spark, folder), ["i", "j"], "left_anti")


def run_blocks(items: DataFrame, id_col: str, vector_col: str, threshold: float, folder: str, *, blocks: int, at_once: int = AT_ONCE, rounds: int | None = None) -> int:
    """Run what is pending, or so many rounds of it. Gives the number of pairs of blocks that were run."""
    spark = items.sparkSession
    dealt = tiles.strips(items, id_col, vector_col, blocks)
    seen = dealt.agg(F.bit_xor(F.xxhash64("id", F.col("v").cast("array<double>"))), F.count("*")).first()
    mark = spark.range(1).select(F.xxhash64(F.lit(seen[0]), F.lit(seen[1]), F.lit(blocks), F.lit(float(threshold)))).first()[0]
    if manifest(spark, folder).where(F.col("mark") != mark).limit(1).count():
        raise ValueError(f"{folder} holds blocks of other items, or of another number of blocks or threshold")
    done = 0
    while rounds is None or rounds > 0:
        todo = pending(spark, folder, blocks).orderBy("i", "j").limit(at_once).collect()
        if not todo:
            break
        asked = spark.createDataFrame([(r["i"], r["i"], r["j"]) for r in todo] + [(r["j"], r["i"], r["j"]) for r in todo if r["i"] != r["j"]], "own int, i int, j int")
        found = dealt.join(F.broadcast(asked), "own").groupBy("i", "j").applyInArrow(tiles.in_tasks(threshold, f"i int, j int, {PAIRS}", _kept), f"i int, j int, {PAIRS}")
        found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("i", "j").parquet(f"{folder}/pairs")
        counts = {(r["i"], r["j"]): r["n"] for r in pairs_of(spark, folder, noted=False).join(F.broadcast(asked.select("i", "j").distinct()), ["i", "j"]).groupBy("i", "j").agg(F.count("*").alias("n")).collect()}
        noted = [(r["i"], r["j"], mark, counts.get((r["i"], r["j"]), 0)) for r in todo]
        spark.createDataFrame(noted, NOTED).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
        done += len(todo)
        rounds = None if rounds is None else rounds - 1
    return done


def _kept(own: tiles.Strips, found: tiles.Tiles) -> Iterator[list]:
    for a, b, score in tiles.every(own, found):
        yield [np.full(len(a), own.low, np.int32), np.full(len(a), own.high, np.int32), a, b, score]


def pairs_of(spark: SparkSession, folder: str, *, noted: bool = True) -> DataFrame:
    """(i, j, a, b, score) of the finished blocks; or of all folders, finished or not."""
    schema = StructType.fromDDL(f"{PAIRS}, i int, j int")
    found = spark.read.schema(schema).parquet(f"{folder}/pairs") if _exists(spark, f"{folder}/pairs") else spark.createDataFrame([], schema)
    return found.join(manifest(spark, folder).select("i", "j"), ["i", "j"], "left_semi") if noted else found


def resumable_pairs(items: DataFrame, id_col: str, vector_col: str, threshold: float, folder: str, *, blocks: int, at_once: int = AT_ONCE) -> DataFrame:
    """(a, b, score) of all pairs at the threshold, a < b, once the blocks that are still pending are done."""
    run_blocks(items, id_col, vector_col, threshold, folder, blocks=blocks, at_once=at_once)
    return pairs_of(items.sparkSession, folder).select("a", "b", "score")
