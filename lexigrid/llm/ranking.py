"""Ranks over whole tables, without gathering them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from lexigrid.llm.common import written

#: Rows in a range.
RANGE_ROWS = 200_000


def ranked(rows: DataFrame, group: list[str], order: list[str], tag: str) -> DataFrame:
    """The rows with rank (from 0) and size of their group; no group is gathered in one task.

    group may be empty: then all rows are one.
    """
    n = max(1, -(-rows.count() // RANGE_ROWS))
    names = [*group, *order]
    dealt = rows.repartitionByRange(n, *names).sortWithinPartitions(*names) if names else rows
    placed = written(dealt.withColumn("__at", F.monotonically_increasing_id()), tag)
    part = F.shiftright("__at", 33).alias("__part")
    held = placed.groupBy(*group, part).agg(F.count("*").alias("__n"), F.min("__at").alias("__least"))
    # a row for each range and group that meet: ranges and groups together at most
    every = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("__n").over(every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = held.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col("__part").alias("__p"), (before - F.col("__least")).alias("__offset"), F.sum("__n").over(every).alias("size"))
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)), part == F.col("__p"))
    return placed.join(offsets, same).withColumn("rank", F.col("__at") + F.col("__offset")).drop("__at", "__p", "__offset", *(f"__g{i}" for i in range(len(group))))
