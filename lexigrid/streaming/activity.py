"""Streaming twins of the activity operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 4) -> DataFrame:
    """New event files of a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def daily_activity(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Events and users per day and type; a day is closed once its watermark has passed."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day"), "event_type")
        .agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"), F.sum("value").alias("total"))
        .select(F.col("window.start").cast("date").alias("day"), "event_type", "n", "users", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "2 days") -> DataFrame:
    """A user's visits: events with no longer gap between them."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), "n")


def whole_sessions(emitted: DataFrame, checkpoint: str) -> DataFrame:
    """The visits of a stream of `sessions` that has ended, each once: user_id, began, ended, n, all closed.

    An event may be in time and yet come after the visit that it goes on with was closed; the stream then has a visit of
    its own for it. Visits of a user that meet are one. So are those that meet one that the stream still holds open, in
    its state, and these aren't closed.
    """
    state = emitted.sparkSession.read.format("statestore").load(checkpoint)
    held = state.select(F.col("value.user_id").alias("user_id"), F.col("value.session_window.start").alias("began"), F.col("value.session_window.end").alias("ended"), F.col("value.count").alias("n"), F.lit(True).alias("open"))
    order = Window.partitionBy("user_id").orderBy("began", "ended")
    upto = F.max("ended").over(order.rowsBetween(Window.unboundedPreceding, -1))
    every = emitted.select("user_id", "began", "ended", "n", F.lit(False).alias("open")).union(held).withColumn("begins", (upto.isNull() | (F.col("began") > upto)).cast("long"))
    visit = every.withColumn("visit", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = visit.groupBy("user_id", "visit").agg(F.min("began").alias("began"), F.max("ended").alias("ended"), F.sum("n").alias("n"), F.max("open").alias("open"))
    return whole.where("NOT open").select("user_id", "began", "ended", "n")


def mastery_step(state: tuple, ok: bool) -> tuple:
    """(level, total, correct, streak, ease, days) after an answer."""
    level, total, correct, streak, ease, days = state
    first, total, correct, streak = total == 0, total + 1, correct + ok, streak + 1 if ok else 0
    if first:
        return "learning", total, correct, streak, ease, 1
    ease = min(2.5, round(ease + 0.1, 1)) if ok else max(1.3, round(ease - 0.2, 1))  # exact tenths
    share = correct / total
    if share >= 0.9 and total >= 5 and streak >= 3:
        return "mastered", total, correct, streak, ease, math.floor(7 * ease)
    if share >= 0.7 and total >= 3:
        return "reviewing", total, correct, streak, ease, math.floor(3 * ease)
    return "learning", total, correct, streak, ease, 1


#: A word's state before its first answer, and what its parts are called.
UNSEEN = ("learning", 0, 0, 0, 2.5, 1)
PARTS = "level string, total int, correct int, streak int, ease double, days int"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held = {word: tuple(s) for word, *s in zip(*state.get, strict=True)} if state.exists else {}
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])  # of one trigger
    touched: dict[str | None, tuple] = {}
    for word, ok in zip(rows["word"].tolist(), (rows["correct"] == True).tolist(), strict=True):  # noqa: E712
        touched[word] = mastery_step(touched.get(word) or held.get(word, UNSEEN), ok)
    held.update(touched)
    state.update(tuple(map(list, zip(*((word, *s) for word, s in held.items()), strict=True))))
    names = [p.split()[0] for p in PARTS.split(", ")]
    yield pd.DataFrame([(key[0], word, *s) for word, s in touched.items()], columns=["user_id", "word", *names])


def mastery_stream(answers: DataFrame) -> DataFrame:
    """The state of each (user_id, word) after each trigger, of (user_id, word, ts, event_id, correct).

    A user's words are kept together, as most of the cost of a state is to fetch it; a trigger gives those that it has answers of.
    Answers of a key have to come in order across triggers, as from a log that is partitioned by key.
    """
    kept = "word array<string>, " + ", ".join(f"{n} array<{t}>" for n, t in (p.split() for p in PARTS.split(", ")))
    return answers.groupBy("user_id").applyInPandasWithState(_update, f"user_id long, word string, {PARTS}", kept, "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is, write it as Parquet, and stop."""
    if mode == "append":
        stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    else:
        stream.writeStream.outputMode(mode).foreachBatch(lambda df, epoch: df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
