"""State that follows from an ordered log of answers, by key, as functions that compose.

A key's events are numbered in the order of their time, then id, and cut into pieces of PIECE. What a
piece does to a state is a small value: an increment between two bounds, a map of a few states, a line.
Such values compose, so a key's state is that of its first event, sent through the values of its pieces.
These are composed FAN at a time, level by level, until one is left. No array holds more than
PIECE events or FAN values, and a key with most of the events is spread over tasks like any other.
What a piece has to know of the events before it, as running counts, comes from a window over the pieces' counts:
one row per piece.

Ease is counted in whole tenths or hundredths, so it is exact whatever the order of composition.
Unknown answers count as wrong; keys may be null; an empty log gives no rows.
The streaming twin in `lexigrid.streaming` keeps only the state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigrid.operators.ranks import with_position
from lexigrid.sources.tables import written

#: Events in a piece; values that are composed at once.
PIECE, FAN = 4096, 4096
#: Beyond all states.
FAR = 10**9
BOUNDED = "struct<add:bigint,low:bigint,high:bigint>"
LINE = "struct<again:boolean,a:double,b:double,c:double>"
#: Longest interval of the schedule, in days. A run of SURE right answers reaches it: from 1 day it goes to 6 and 14, then by 1.3 at least.
LONGEST_DAYS, SURE = 36_500, 64
#: What right answers add to the ease, in hundredths, for the first, the second and third, and later ones of a run.
RUN_STEPS = (-14, 0, 10)


def _null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join in which nulls are equal; the columns of `on` once."""
    named = right.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(on)), *(c for c in right.columns if c not in on))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(on)))
    return left.join(named, same).drop(*(f"__{i}" for i in range(len(on))))


def _numbered(events: DataFrame, keys: list[str], **more: Column) -> DataFrame:
    """keys, ts, pos (from 0), piece, ok and the columns in more, written once."""
    rows = events.select(*keys, "ts", "event_id", F.coalesce(F.col("correct"), F.lit(False)).alias("ok"), *(c.alias(n) for n, c in more.items()))
    placed = with_position(rows, keys, ["ts", "event_id"], "pos")
    return written(placed.withColumn("piece", F.floor(F.col("pos") / PIECE).cast("long")), "folds-numbered")


def _logs(numbered: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """keys, piece, log: the events of each piece in order."""
    return numbered.groupBy(*keys, "piece").agg(F.sort_array(F.collect_list(F.struct("pos", *columns))).alias("log"))


def _totals(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total, correct, wrong (the position of the last wrong answer, or -1), last_seen; summed in the tasks first."""
    wrong = F.coalesce(F.max(F.when(~F.col("ok"), F.col("pos"))), F.lit(-1))
    return numbered.groupBy(*keys).agg(F.count("*").cast("int").alias("total"), F.count_if("ok").cast("int").alias("correct"), wrong.alias("wrong"), F.max("ts").alias("last_seen"))


def _before(numbered: DataFrame, keys: list[str]) -> DataFrame:
    """keys, piece, and what came before the piece: right answers, position of the last wrong one; last: that of the whole key."""
    counted = numbered.groupBy(*keys, "piece").agg(F.count_if("ok").alias("right"), F.max(F.when(~F.col("ok"), F.col("pos"))).alias("wrong"))
    w = Window.partitionBy(*keys)
    earlier = w.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c, value: F.coalesce(c, F.lit(value))
    return counted.select(*keys, "piece", none(F.sum("right").over(earlier), 0).alias("right"), none(F.max("wrong").over(earlier), -1).alias("wrong"), none(F.max("wrong").over(w), -1).alias("last"))


def composed(parts: DataFrame, keys: list[str], compose) -> DataFrame:
    """keys, s: the values s of each key's pieces, composed in their order, FAN at a time."""
    while True:
        grouped = parts.groupBy(*keys, F.floor(F.col("piece") / FAN).cast("long").alias("piece")).agg(F.sort_array(F.collect_list(F.struct("piece", "s"))).alias("p"))
        rest = F.slice("p", F.lit(2), F.size("p") - 1)
        parts = written(grouped.select(*keys, "piece", F.aggregate(rest, F.col("p")[0]["s"], lambda s, x: compose(s, x["s"])).alias("s")), "folds-composed")
        if not parts.where("piece > 0").limit(1).count():
            return parts.drop("piece")


def _bounded(add: Column | int, low: Column | int, high: Column | int) -> Column:
    """x -> min(high, max(low, x + add))."""
    whole = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(whole(add).cast("long").alias("add"), whole(low).cast("long").alias("low"), whole(high).cast("long").alias("high")).cast(BOUNDED)


def then_bounded(f: Column, g: Column) -> Column:
    """f, then g, as one bounded increment."""
    meet = lambda x: F.least(g["high"], F.greatest(g["low"], x + g["add"]))
    return _bounded(f["add"] + g["add"], meet(f["low"]), meet(f["high"]))


def _apply(f: Column, x: Column) -> Column:
    return F.least(f["high"], F.greatest(f["low"], x + f["add"]))


NO_STEP = (0, -FAR, FAR)


def mastery(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, level, total, correct, streak, ease, days to the next review, last_seen.

    The first answer makes a learning item with ease 2.5 and one day. Later ones add 0.1 to the ease, at
    most 2.5, or take 0.2 off, at least 1.3; levels need 90 % of five with a streak of three, or 70 % of three.
    """
    numbered = _numbered(events, keys)

    def step(s: Column, e: Column) -> Column:
        one = F.when(e["pos"] == 0, _bounded(*NO_STEP)).when(e["ok"], _bounded(1, -FAR, 25)).otherwise(_bounded(-2, 13, FAR))
        return then_bounded(s, one)

    parts = _logs(numbered, keys, "ok").select(*keys, "piece", F.aggregate("log", _bounded(*NO_STEP), step).alias("s"))
    found = _null_safe(_totals(numbered, keys), composed(parts, keys, then_bounded), keys)
    share, tenths = F.col("correct") / F.col("total"), _apply(F.col("s"), F.lit(25))
    stated = found.select(*keys, "total", "correct", (F.col("total") - 1 - F.col("wrong")).cast("int").alias("streak"), tenths.alias("tenths"), share.alias("share"), "last_seen")
    level = F.when((F.col("share") >= 0.9) & (F.col("total") >= 5) & (F.col("streak") >= 3), "mastered").when((F.col("share") >= 0.7) & (F.col("total") >= 3), "reviewing").otherwise("learning")
    days = F.when(F.col("level") == "mastered", F.floor(7 * F.col("tenths") / 10)).when(F.col("level") == "reviewing", F.floor(3 * F.col("tenths") / 10)).otherwise(1)
    return stated.withColumn("level", level).select(*keys, "level", "total", "correct", "streak", (F.col("tenths") / 10).alias("ease"), days.cast("int").alias("days"), "last_seen")


def _run_step(run: Column) -> Column:
    return F.when(run <= 1, RUN_STEPS[0]).when(run <= 3, RUN_STEPS[1]).otherwise(RUN_STEPS[2])


def schedule(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total, correct, run, days, ease, level, last_seen: the SM-2 rule; quality follows from the run of answers.

    A wrong answer takes 0.2 off the ease, at least 1.3, and sets the interval to a day. The n-th right answer of a run
    has quality 3, 4, 4, 5, 5, ...; the interval goes from 1 to 6 and 14 days, then by the ease so far. So the
    interval follows from the last run and the ease when it began.
    """
    numbered = _numbered(events, keys)
    logs = _null_safe(_logs(numbered, keys, "ok"), _before(numbered, keys), [*keys, "piece"])
    state = "struct<wrong:bigint,f:" + BOUNDED + ">"

    def step(s: Column, e: Column) -> Column:
        one = F.when(e["ok"], _bounded(_run_step(e["pos"] - s["wrong"]), 130, FAR)).otherwise(_bounded(-20, 130, FAR))
        return F.struct(F.when(e["ok"], s["wrong"]).otherwise(e["pos"]).alias("wrong"), then_bounded(s["f"], one).alias("f")).cast(state)

    begin = F.struct(F.col("wrong").cast("long").alias("wrong"), _bounded(*NO_STEP).alias("f")).cast(state)
    upto = F.filter("log", lambda e: e["pos"] <= F.col("last"))
    parts = logs.select(*keys, "piece", F.aggregate(upto, begin, step)["f"].alias("s"))
    found = _null_safe(_totals(numbered, keys), composed(parts, keys, then_bounded), keys)
    run = F.col("total") - 1 - F.col("wrong")
    last = "struct<days:bigint,ease:bigint>"

    def right(v: Column, n: Column) -> Column:
        days = F.when(v["days"] == 1, 6).when(v["days"] == 6, 14).otherwise(F.floor(v["days"] * v["ease"] / 100))
        return F.struct(F.least(days.cast("long"), F.lit(LONGEST_DAYS)).cast("long").alias("days"), F.greatest(v["ease"] + _run_step(n), F.lit(130)).cast("long").alias("ease")).cast(last)

    began = F.struct(F.lit(1).cast("long").alias("days"), _apply(F.col("s"), F.lit(250)).alias("ease")).cast(last)
    steps = F.when(F.col("run") > 0, F.sequence(F.lit(1).cast("long"), F.least("run", F.lit(SURE)))).otherwise(F.array().cast("array<bigint>"))
    ended = found.withColumn("run", run).withColumn("v", F.aggregate(steps, began, right))
    ease = F.col("v.ease") + RUN_STEPS[2] * F.greatest(F.col("run") - SURE, F.lit(0))
    share = F.col("correct") / F.col("total")
    level = F.when((F.col("run") >= 5) & (share >= 0.8), "mastered").when((F.col("run") >= 2) & (share >= 0.6), "reviewing").otherwise("learning")
    return ended.select(*keys, "total", "correct", F.col("run").cast("int").alias("run"), F.col("v.days").cast("int").alias("days"), (ease / 100).alias("ease"), level.alias("level"), "last_seen")


def _card_states() -> tuple[list[int], list[int], list[int]]:
    """The intervals that cards can have, and the place of the next one after a right and a wrong answer."""
    right, wrong = (lambda d: min(2 * d, 30)), (lambda d: max(d // 2, 1))
    found, asked = {1}, [1]
    while asked:
        d = asked.pop()
        for e in (right(d), wrong(d)):
            if e not in found:
                found.add(e)
                asked.append(e)
    days = sorted(found)
    return days, [days.index(right(d)) for d in days], [days.index(wrong(d)) for d in days]


DAYS, RIGHT, WRONG = _card_states()


def cards(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, studied, correct, days, level, last_seen: intervals double to 30 days at most, or halve to one at least.

    A level stays until the answers so far ask for another one, so it is the last that they asked for.
    """
    numbered = _numbered(events, keys)
    logs = _null_safe(_logs(numbered, keys, "ok"), _before(numbered, keys), [*keys, "piece"])
    whole = lambda xs: F.array(*map(F.lit, xs))
    state = "struct<s:array<int>,correct:bigint,level:string>"

    def step(v: Column, e: Column) -> Column:
        first, correct, studied = e["pos"] == 0, v["correct"] + e["ok"].cast("int"), e["pos"] + 1
        table = F.when(e["ok"], whole(RIGHT)).otherwise(whole(WRONG))
        to = F.when(first, F.array_repeat(F.lit(DAYS.index(1)), len(DAYS))).otherwise(F.transform(v["s"], lambda i: F.get(table, i)))
        level = F.when(first, "learning").when((correct >= studied * 0.9) & (studied >= 5), "mastered").when((correct >= studied * 0.8) & (studied >= 3), "reviewing").otherwise(v["level"])
        return F.struct(to.alias("s"), correct.alias("correct"), level.alias("level")).cast(state)

    begin = F.struct(whole(range(len(DAYS))).alias("s"), F.col("right").cast("long").alias("correct"), F.lit(None).cast("string").alias("level")).cast(state)
    parts = written(logs.select(*keys, "piece", F.aggregate("log", begin, step).alias("v")).select(*keys, "piece", "v.s", "v.level"), "folds-pieces")
    levels = parts.where("level IS NOT NULL").groupBy(*keys).agg(F.max_by("level", "piece").alias("level"))
    maps = composed(parts.select(*keys, "piece", "s"), keys, lambda f, g: F.transform(f, lambda i: F.get(g, i)))
    found = _null_safe(_null_safe(_totals(numbered, keys), maps, keys), levels, keys)
    return found.select(*keys, F.col("total").alias("studied"), "correct", F.get(whole(DAYS), F.col("s")[0]).alias("days"), "level", "last_seen")


def running_confidence(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, confidence, n: each later value is averaged with what stood before, so recent ones weigh more.

    A null value makes what stood before unknown; the next value then stands alone.
    A piece is a line a x + b for a known x, and c for an unknown one, or c for any, if it holds a null.
    """
    numbered = _numbered(events.withColumn("correct", F.lit(True)), keys, v=F.col(value).cast("double"))

    def line(again: Column, a: Column, b: Column, c: Column) -> Column:
        return F.struct(again.alias("again"), a.alias("a"), b.alias("b"), c.alias("c")).cast(LINE)

    def step(s: Column, e: Column) -> Column:
        unknown, v = e["v"].isNull(), e["v"]
        return line(s["again"] | unknown, s["a"] / 2, (s["b"] + F.coalesce(v, F.lit(0.0))) / 2, F.when(unknown, None).when(s["c"].isNull(), v).otherwise((s["c"] + v) / 2))

    def then(f: Column, g: Column) -> Column:
        c = F.when(g["again"] | f["c"].isNull(), g["c"]).otherwise(f["c"] * g["a"] + g["b"])
        return line(f["again"] | g["again"], f["a"] * g["a"], f["b"] * g["a"] + g["b"], c)

    begin = line(F.lit(False), F.lit(1.0), F.lit(0.0), F.lit(None).cast("double"))
    parts = _logs(numbered, keys, "v").select(*keys, "piece", F.aggregate("log", begin, step).alias("s"))
    found = _null_safe(_totals(numbered, keys), composed(parts, keys, then), keys)
    return found.select(*keys, F.col("s.c").alias("confidence"), F.col("total").alias("n"))
