"""Writes of keyed tables as batch jobs: a new version of a table from the old one and a change set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the latest version of each key, of both tables."""
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last())
    return old.unionByName(new).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """old, and the first new row of each key that old lacks."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return old.unionByName(fresh)


def accumulate(old: DataFrame, new: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Counters of old plus those of new."""
    return old.select(*keys, *sums).unionByName(new.select(*keys, *sums)).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def update_from(old: DataFrame, new: DataFrame, key: str, column: str, *, only_missing: bool = False) -> DataFrame:
    """old with the column taken from new where it has the key (and, if asked, only where old has none)."""
    given = new.select(key, F.col(column).alias("__new"))
    value = F.coalesce(column, "__new") if only_missing else F.coalesce("__new", column)
    return old.join(given, key, "left").withColumn(column, value).drop("__new")


def move(source: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that move, and rows that stay; a condition that is null stays."""
    holds = F.coalesce(where, F.lit(False))
    return source.where(holds), source.where(~holds)


def unvisited(urls: DataFrame, visits: DataFrame, as_of: Column, days: int = 120) -> DataFrame:
    """Urls whose key wasn't visited within the days before as_of."""
    recent = visits.where(F.col("last_visited") > as_of - F.make_interval(days=F.lit(days))).select("url_hash").distinct()
    return urls.withColumn("url_hash", F.sha2("url", 256)).join(recent, "url_hash", "left_anti")


def table_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str], tolerance: float = 1e-5) -> DataFrame:
    """key and status (added, removed, changed) of rows that differ; numbers may differ by the tolerance."""
    a = old.select(key, *(F.col(c).alias(f"__a_{c}") for c in columns), F.lit(True).alias("__in_a"))
    b = new.select(key, *(F.col(c).alias(f"__b_{c}") for c in columns), F.lit(True).alias("__in_b"))
    numeric = {n for n, t in old.dtypes if t in ("double", "float") or t.startswith("decimal")}

    def same(c: str) -> Column:
        x, y = F.col(f"__a_{c}"), F.col(f"__b_{c}")
        near = F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)) if c in numeric else F.lit(False)
        return x.eqNullSafe(y) | near

    differ = F.lit(False)
    for c in columns:
        differ = differ | ~same(c)
    status = F.when(F.col("__in_a").isNull(), "added").when(F.col("__in_b").isNull(), "removed").when(differ, "changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status")).where("status IS NOT NULL")


def counter_mismatch(stored: DataFrame, log: DataFrame, key: str, counter: str) -> DataFrame:
    """Rows whose stored counter isn't the number of log rows."""
    counted = log.groupBy(key).agg(F.count("*").alias("actual"))
    return stored.select(key, F.col(counter).alias("stored")).join(counted, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0))).where("stored <> actual")


def due_sources(known: DataFrame, runs: DataFrame, source: str, as_of: Column, *, hours: int = 1) -> DataFrame:
    """source and why (new, failed, old) of those to run: a run that failed is repeated at once, others after some hours."""
    last = runs.groupBy(source).agg(F.max_by("failed", F.struct("ts", "event_id")).alias("failed"), F.max("ts").alias("last"))
    old = F.col("last") <= as_of - F.make_interval(hours=F.lit(hours))
    why = F.when(F.col("last").isNull(), "new").when(F.col("failed"), "failed").when(old, "old")
    return known.join(last, source, "left").select(source, why.alias("why")).where("why IS NOT NULL")
