"""Folds as composed pieces, against answers taken one by one; pieces are small, so that keys have many levels of them."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import state

SCHEMA = "user_id long, word string, ts timestamp, event_id long, correct boolean, value double"
KEYS = ["user_id", "word"]


def logs():
    """A key with a third of all events, long runs, ties in time, nulls, keys of one event."""
    rng, began, out = random.Random(2), datetime(2024, 1, 1), []

    def add(user, word, n, share, spread=10_000):
        for _ in range(n):
            ok = rng.choice([None, rng.random() < share]) if rng.random() < 0.05 else rng.random() < share
            out.append((user, word, began + timedelta(seconds=rng.randrange(spread)), len(out), ok, None if rng.random() < 0.02 else rng.random() * 100))

    add(1, "hot", 700, 0.85)
    add(2, "easy", 150, 1.1)
    add(3, "hard", 90, -1)
    add(None, None, 60, 0.7)
    add(4, None, 40, 0.6, 3)
    for user in range(10, 110):
        add(user, "some", rng.randrange(1, 25), rng.random())
    rng.shuffle(out)
    return out


def by_key(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        found.setdefault(r[:2], []).append(r)
    return found


def mastery(answers):
    total = correct = streak = 0
    tenths = 25
    for ok in answers:
        if total:
            tenths = min(25, tenths + 1) if ok else max(13, tenths - 2)
        total, correct, streak = total + 1, correct + ok, streak + 1 if ok else 0
    level = "mastered" if correct / total >= 0.9 and total >= 5 and streak >= 3 else "reviewing" if correct / total >= 0.7 and total >= 3 else "learning"
    return level, total, correct, streak, tenths / 10, {"mastered": 7 * tenths // 10, "reviewing": 3 * tenths // 10, "learning": 1}[level]


def schedule(answers):
    total = correct = run = 0
    days, ease = 1, 250
    for ok in answers:
        total, correct, run = total + 1, correct + ok, run + 1 if ok else 0
        if ok:
            days = min(36_500, 6 if days == 1 else 14 if days == 6 else days * ease // 100)
            ease = max(130, ease + {3: -14, 4: 0, 5: 10}[min(5, 3 + run // 2)])
        else:
            days, ease = 1, max(130, ease - 20)
    share = correct / total
    return total, correct, run, days, ease / 100, "mastered" if run >= 5 and share >= 0.8 else "reviewing" if run >= 2 and share >= 0.6 else "learning"


def cards(answers):
    studied = correct = 0
    days, level = 1, "learning"
    for ok in answers:
        if studied:
            days = min(2 * days, 30) if ok else max(days // 2, 1)
        studied, correct = studied + 1, correct + ok
        if studied > 1 and correct >= studied * 0.9 and studied >= 5:
            level = "mastered"
        elif studied > 1 and correct >= studied * 0.8 and studied >= 3:
            level = "reviewing"
    return studied, correct, days, level


@pytest.fixture(params=[(4, 3), (state.PIECE, state.FAN)], ids=["small", "whole"])
def pieces(request, monkeypatch):
    monkeypatch.setattr(state, "PIECE", request.param[0])
    monkeypatch.setattr(state, "FAN", request.param[1])


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(logs(), SCHEMA).repartition(5).cache()


@pytest.mark.parametrize("fold, plain", [(state.mastery, mastery), (state.schedule, schedule), (state.cards, cards)], ids=["mastery", "schedule", "cards"])
def test_fold(spark, events, pieces, fold, plain):
    got = {tuple(r)[:2]: tuple(r)[2:] for r in fold(events, KEYS).collect()}
    assert got == {key: (*plain([bool(r[4]) for r in rows]), rows[-1][2]) for key, rows in by_key(logs()).items()}


def test_running_confidence(spark, events, pieces):
    got = {tuple(r)[:2]: tuple(r)[2:] for r in state.running_confidence(events, KEYS, "value").collect()}
    for key, rows in by_key(logs()).items():
        c = None
        for r in rows:
            c = r[5] if c is None else None if r[5] is None else (c + r[5]) / 2
        assert got[key] == ((pytest.approx(c, rel=1e-12) if c is not None else None), len(rows))


def test_nothing(spark, events):
    none = events.where("false")
    for fold in (state.mastery, state.schedule, state.cards):
        assert fold(none, KEYS).count() == 0
    assert state.running_confidence(none, KEYS, "value").count() == 0


def test_hot_key_is_in_many_pieces(spark, events, monkeypatch):
    monkeypatch.setattr(state, "PIECE", 16)
    numbered = state._numbered(events, KEYS)
    logs_ = state._logs(numbered, KEYS, "ok")
    most, hot = logs_.agg(F.max(F.size("log")), F.count_if(F.col("word") == "hot")).first()
    assert most == 16 and hot == 44
    positions = [r["pos"] for r in numbered.where("word = 'hot'").orderBy("ts", "event_id").collect()]
    assert positions == list(range(700))


def test_runs_reach_the_longest_interval():
    """The schedule counts on SURE right answers to reach LONGEST_DAYS from any ease."""
    days, ease = 1, 130
    for n in range(1, state.SURE + 1):
        days = min(state.LONGEST_DAYS, 6 if days == 1 else 14 if days == 6 else days * ease // 100)
        ease = max(130, ease + state.RUN_STEPS[0 if n <= 1 else 1 if n <= 3 else 2])
    assert days == state.LONGEST_DAYS
