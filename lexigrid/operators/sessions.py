"""Visits: a key's events with no gap between them that is longer than allowed. The batch twin of session windows.

Events are sorted into ranges by key and time. Within a range a visit begins where the event before is too far back;
the first event of a key in a range looks at the key's last one in the ranges before, of which there is a row
per range and key. So a key with most of the events is spread over as many tasks as it has ranges.

Events without a time are left out, as session windows leave them out; null keys are a key.
An event exactly one gap after another is of the same visit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from lexigrid.sources.tables import written


def visits(events: DataFrame, keys: list[str], gap: str, ts: str = "ts") -> DataFrame:
    """keys, began, ended (the last event's time and a gap more) and n."""
    rows = events.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("t"))
    placed = written(rows.repartitionByRange(*keys, "t").sortWithinPartitions(*keys, "t").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "visits")
    allowed = F.expr(f"INTERVAL {gap}")
    local = Window.partitionBy(*keys, "part").orderBy("at")
    edges = Window.partitionBy(*keys).orderBy("part")
    last = placed.groupBy(*keys, "part").agg(F.max("t").alias("last"))
    before = last.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col("part").alias("p"), F.lag("last").over(edges).alias("earlier"))
    same = lambda right: reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"k{i}")) for i, k in enumerate(keys)), F.col("part") == F.col(right))
    gone = [f"k{i}" for i in range(len(keys))]
    seen = placed.join(before, same("p")).drop(*gone, "p").withColumn("previous", F.coalesce(F.lag("t").over(local), "earlier"))
    begins = F.col("previous").isNull() | (F.col("t") > F.col("previous") + allowed)
    marked = written(seen.select(*keys, "part", "at", "t", F.sum(begins.cast("long")).over(local).alias("visit")), "visits-marked")
    counts = marked.groupBy(*keys, "part").agg(F.max("visit").alias("n"))
    offsets = counts.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col("part").alias("p"), F.coalesce(F.sum("n").over(edges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    whole = marked.join(offsets, same("p")).withColumn("visit", F.col("visit") + F.col("offset"))
    return whole.groupBy(*keys, "visit").agg(F.min("t").alias("began"), (F.max("t") + allowed).alias("ended"), F.count("*").alias("n")).drop("visit")


def on_time(events: DataFrame, batch: str, gap: str, delay: str, ts: str = "ts") -> DataFrame:
    """The events that a stream takes, batch by batch, with a watermark: those that aren't late.

    Spark drops an event if its visit, a gap long, would have ended by the watermark that closed visits in the batch before.
    That is the latest time of all batches but the last two, less the delay. `closed` is the watermark at the end.
    An event that isn't late, but near a visit that was closed before it came, is a visit of its own in the stream.
    """
    rows = events.where(F.col(ts).isNotNull())
    latest = rows.groupBy(F.col(batch).alias("b")).agg(F.max(ts).alias("latest"))  # a row per batch
    order = Window.orderBy("b")
    marks = latest.select("b", (F.max("latest").over(order.rowsBetween(Window.unboundedPreceding, -2)) - F.expr(f"INTERVAL {delay}")).alias("mark"), (F.max("latest").over(Window.partitionBy()) - F.expr(f"INTERVAL {delay}")).alias("closed"))
    met = rows.join(F.broadcast(marks), F.col(batch) == F.col("b")).drop("b")
    return met.where(F.col("mark").isNull() | (F.col(ts) + F.expr(f"INTERVAL {gap}") > F.col("mark"))).drop("mark")
