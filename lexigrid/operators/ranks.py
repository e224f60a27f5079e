"""Ranks over a whole table, without gathering it in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigrid.sources.tables import written

CUTS = 64
#: So many distinct values are numbered in one range, beyond that in CUTS ranges.
ONE_RANGE = 100_000


def _numbered(values: DataFrame, col: str, weight: str, descending: bool) -> DataFrame:
    """values with __before, the sum of weights of all values that come first; nulls come last.

    Values are dealt to ranges by cut points, summed there in parallel, and offset by the ranges' totals.
    """
    many = values.count() > ONE_RANGE
    cuts = sorted(set(values.approxQuantile(col, [i / CUTS for i in range(1, CUTS)], 0.005))) if many else []
    at = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= F.col(col))) if cuts else F.lit(0)
    at = F.when(F.col(col).isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - at if descending else at)
    ranged = values.withColumn("__range", at)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    order = F.col(col).desc_nulls_last() if descending else F.col(col).asc_nulls_last()
    totals = ranged.groupBy("__range").agg(F.sum(weight).alias("__t"))  # a row per range
    offsets = totals.select("__range", F.coalesce(F.sum("__t").over(before(Window.orderBy("__range"))), F.lit(0)).alias("__offset"))
    inner = F.coalesce(F.sum(weight).over(before(Window.partitionBy("__range").orderBy(order))), F.lit(0))
    return ranged.withColumn("__inner", inner).join(F.broadcast(offsets), "__range").withColumn("__before", F.col("__inner") + F.col("__offset")).drop("__range", "__inner", "__offset")


def with_rank(df: DataFrame, col: str, out: str, *, descending: bool = False) -> DataFrame:
    """RANK() over all rows by a numeric column, nulls last: rows with equal values share one."""
    values = written(df.groupBy(F.col(col).cast("double").alias("__v")).agg(F.count("*").alias("__n")), "rank-values")
    ranks = _numbered(values, "__v", "__n", descending).select("__v", (F.col("__before") + 1).cast("long").alias(out))
    return df.join(ranks, F.col(col).cast("double").eqNullSafe(F.col("__v"))).drop("__v")


def with_percent_rank(df: DataFrame, col: str, out: str) -> DataFrame:
    """PERCENT_RANK() over all rows, nulls last and among the rows."""
    n = df.count()
    ranked = with_rank(df, col, "__rank")
    share: Column = (F.col("__rank") - 1) / F.lit(n - 1) if n > 1 else F.lit(0.0)
    return ranked.withColumn(out, share.cast("double")).drop("__rank")


def with_row_number(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """ROW_NUMBER() over all rows in a total order: sorted by ranges, numbered in each, and offset."""
    placed = written(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "row-numbers")
    part = F.shiftright("__id", 33)
    sizes = placed.groupBy(part.alias("__part")).agg((F.max("__id") - F.min("__id") + 1).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return placed.join(F.broadcast(offsets), part == F.col("__part")).withColumn(out, (F.col("__id").bitwiseAND((1 << 33) - 1) + F.col("__offset") + 1).cast("long")).drop("__id", "__part", "__offset")


def with_position(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """The place of each row in its group, from 0, in ascending order; nulls first. No group is gathered in one task.

    Rows are sorted into ranges by group and order; a group's rows in earlier ranges, one count for each, are added.
    """
    names = [*group, *order]
    placed = written(df.repartitionByRange(*names).sortWithinPartitions(*names).withColumn("__at", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("__at", 33)
    held = placed.groupBy(*group, part.alias("__part")).agg(F.count("*").alias("__n"), F.min("__at").alias("__least"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col("__part").alias("__p"), (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__least")).alias("__offset"))
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)), part == F.col("__p"))
    return placed.join(offsets, same).withColumn(out, F.col("__at") + F.col("__offset")).drop("__at", "__p", "__offset", *(f"__g{i}" for i in range(len(group))))
