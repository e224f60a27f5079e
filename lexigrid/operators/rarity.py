"""Rarity of terms: blended from several frequency sources, ranked, banded, counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigrid.operators.ranks import with_percent_rank
from lexigrid.sources.tables import CORPORA, NOT_FOUND

#: What each source weighs in the blend.
WEIGHTS = (0.45, 0.35, 0.20)
#: Upper bounds of the rarity bands; all above are the last.
BANDS = ((0.2, "common"), (0.4, "somewhat common"), (0.6, "somewhat rare"), (0.8, "rare"))
LAST_BAND = "ultra-rare"


def ladder(value: Column, steps: tuple[tuple[float, str], ...], last: str) -> Column:
    """The label of the first bound above the value, else `last`; null stays null."""
    out = None
    for bound, label in steps:
        out = F.when(value < bound, label) if out is None else out.when(value < bound, label)
    return F.when(value.isNotNull(), out.otherwise(last))


def renormalised(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that aren't null; null if none is."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for value, weight in parts:
        top = top + F.coalesce(value * weight, F.lit(0.0))
        bottom = bottom + F.when(value.isNotNull(), F.lit(weight)).otherwise(0.0)
    return F.when(bottom > 0, top / bottom)


def blend(terms: DataFrame, sources: tuple[str, ...] = CORPORA, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """terms with <source>_rarity, final_rarity and num_sources.

    Terms that weren't found or checked stay in the ranking of a source, and are masked after it.
    """
    out = terms
    for s in sources:
        out = with_percent_rank(out, s, f"__{s}")
    for s in sources:
        out = out.withColumn(f"{s}_rarity", F.when(F.col(s).isNotNull() & (F.col(s) != NOT_FOUND), 1.0 - F.col(f"__{s}"))).drop(f"__{s}")
    rarities = [F.col(f"{s}_rarity") for s in sources]
    count = sum((r.isNotNull().cast("int") for r in rarities[1:]), rarities[0].isNotNull().cast("int"))
    return out.withColumns({"final_rarity": renormalised(list(zip(rarities, weights, strict=True))), "num_sources": count})


def band(value: Column) -> Column:
    return ladder(value, BANDS, LAST_BAND)


def histogram(df: DataFrame, col: str, buckets: int = 20) -> DataFrame:
    """bucket, n: values clamped to [0, 1) in equal buckets, 4 to 100 of them; empty ones have n = 0."""
    buckets = min(max(buckets, 4), 100)
    at = F.floor(F.least(F.greatest(F.col(col), F.lit(0.0)), F.lit(0.999999)) * buckets).cast("int")
    counted = df.where(F.col(col).isNotNull()).groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def quartiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """Exact quartiles with linear interpolation, mean and count of each group."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(group).agg(F.count(value).alias("n"), q.alias("q"), F.min(value).alias("low"), F.max(value).alias("high")).select(group, "n", "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high")


def coverage(df: DataFrame) -> DataFrame:
    """How many terms have how many sources."""
    return df.groupBy("num_sources").agg(F.count("*").alias("n"))


def shares(df: DataFrame, group: str) -> DataFrame:
    """Rows of each group, and their share of all: a window over the groups alone."""
    counted = df.groupBy(group).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))
