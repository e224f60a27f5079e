"""Learning activity: accuracy, trends, streaks, habits, decks and sources. Times are relative to a given one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def accuracy_by(results: DataFrame, *keys: str) -> DataFrame:
    """keys, total, correct, accuracy in percent, of rows with a boolean `correct`."""
    return results.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("correct").alias("correct")).withColumn("accuracy", F.try_divide(F.col("correct") * 100.0, F.col("total")))


def weak(groups: DataFrame, least: int, below: float) -> DataFrame:
    return groups.where((F.col("total") >= least) & (F.col("accuracy") < below))


def overview(sessions: DataFrame, results: DataFrame) -> DataFrame:
    """Per user: sessions, completed ones, questions and correct answers; results are summed by session first."""
    per = results.groupBy("session_id").agg(F.count("*").alias("q"), F.count_if("correct").alias("c"))
    return sessions.join(per, "session_id", "left").groupBy("user_id").agg(
        F.count("*").alias("sessions"), F.count_if("completed").alias("completed"), F.coalesce(F.sum("q"), F.lit(0)).alias("questions"), F.coalesce(F.sum("c"), F.lit(0)).alias("correct")
    )


def daily(results: DataFrame) -> DataFrame:
    """user_id, day, total, correct."""
    return results.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("total"), F.count_if("correct").alias("correct"))


def streaks(days: DataFrame, least: float = 0.7, most: int = 30) -> DataFrame:
    """user_id, streak: latest days in a row with that accuracy, of at most 30; days without activity don't count."""
    w = Window.partitionBy("user_id").orderBy(F.col("day").desc())
    marked = days.withColumns({"n": F.row_number().over(w), "missed": F.sum((F.col("correct") / F.col("total") < least).cast("int")).over(w)})
    return marked.groupBy("user_id").agg(F.count_if((F.col("missed") == 0) & (F.col("n") <= most)).alias("streak"))


def trends(points: DataFrame, by: float = 2.0) -> DataFrame:
    """user_id, slope, trend of (user_id, x, y): improving or declining if the slope of y over x passes `by`."""
    fitted = points.groupBy("user_id").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"))
    return fitted.select("user_id", "slope", F.when((F.col("n") >= 3) & (F.col("slope") > by), "improving").when((F.col("n") >= 3) & (F.col("slope") < -by), "declining").otherwise("stable").alias("trend"))


def commonest(df: DataFrame, key: str, value: Column, out: str) -> DataFrame:
    """key, out, n: the value with most rows; ties: the least value."""
    counts = df.groupBy(key, value.alias(out)).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.col("n").desc(), F.col(out))
    return counts.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def consistency(events: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """user_id, active_days, score: share of the last days with any event, in percent."""
    recent = events.where((F.col("ts") > as_of - F.make_interval(days=F.lit(days))) & (F.col("ts") <= as_of))
    return recent.groupBy("user_id").agg(F.countDistinct(F.to_date("ts")).alias("active_days")).withColumn("score", F.col("active_days") * 100.0 / days)


def mastery_score(level: Column) -> Column:
    return F.when(level == "mastered", 100.0).when(level == "reviewing", 60.0).otherwise(20.0)


def item_status(level: Column, next_review: Column, as_of: Column) -> Column:
    return F.when(next_review.isNull(), "unknown").when(next_review <= as_of, "due").when(next_review <= as_of + F.make_interval(days=F.lit(1)), "due_soon").when(level == "mastered", "mastered").otherwise("learning")


def review_order(level: Column, next_review: Column, difficulty: Column, last: Column) -> list[Column]:
    """What to review first: by level, then the earliest, then the hardest."""
    return [F.when(level == "learning", 1).when(level == "reviewing", 2).otherwise(3).asc(), next_review.asc_nulls_last(), difficulty.desc_nulls_last(), last.asc()]


def source_scores(visits: DataFrame) -> DataFrame:
    """source, score: 40 % success, 40 % finds per success up to ten, 20 % speed; one half below three visits."""
    s = visits.groupBy("source").agg(F.count("*").alias("visits"), F.count_if("ok").alias("oks"), F.sum("found").alias("found"), F.avg("ms").alias("ms"))
    per = F.coalesce(F.try_divide(F.col("found"), F.col("oks")), F.lit(0.0))
    mixed = 0.4 * F.col("oks") / F.col("visits") + 0.4 * F.least(F.lit(1.0), per / 10.0) + 0.2 * F.greatest(F.lit(0.0), 1.0 - F.col("ms") / 5000.0)
    return s.select("source", "visits", F.when(F.col("visits") < 3, 0.5).otherwise(mixed).alias("score"))


def reliability(rows: DataFrame, key: str) -> DataFrame:
    """key, reliability: mean of r weighted by r and the source's tier, of (key, r, tier)."""
    w = (5 - F.col("tier")) * F.col("r")
    return rows.groupBy(key).agg(F.coalesce(F.try_divide(F.sum(F.col("r") * w), F.sum(w)), F.lit(0.0)).alias("reliability"))


def best_by(rows: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The row with the best score of each key; ties: the first."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.col(tie).asc())
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
