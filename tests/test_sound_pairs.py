"""Pairs of sounds: distances as by a plain table, strips as without, crowded ends."""

import random

import numpy as np

from lexigrid.functions import phonetic
from lexigrid.operators import edits, pairs
from lexigrid.plans import texts
from pyspark.sql import functions as F


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def strings(n, seed, letters="AEIKNST"):
    rng = random.Random(seed)
    out = [("".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 8, 9, 12, 300 if k < 3 else 5])))) for k in range(n)]
    return out + [s[:2] + "é" + s[3:] for s in out[: n // 3]]


def test_distances_and_close_texts_as_by_plain_tables():
    said = strings(120, 1)
    codes, sizes = edits._codes(said)
    a, b = np.triu_indices(len(said), 1)
    expected = np.array([plain(said[x], said[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    assert (edits.distances(codes[a], sizes[a], codes[b], sizes[b]) == expected).all()
    share = lambda m, n: 0.3 - 0.1 * np.abs(m - n)
    numbers = np.arange(len(said)) % 3
    fits = expected <= np.floor(share(numbers[a], numbers[b]) * np.maximum(sizes[a], sizes[b]))
    wanted = {frozenset(p) for p in zip(a[fits].tolist(), b[fits].tolist(), strict=True)}
    side = np.arange(len(said)) % 2 == 1
    for second in (np.zeros(len(said), bool), side):
        found = [frozenset(p) for l, r in edits.Strips(said, numbers, second).close(share, 0.3) for p in zip(l.tolist(), r.tolist(), strict=True)]  # noqa: E741
        assert len(found) == len(set(found)) and set(found) == (wanted if second is not side else {p for p in wanted if len({side[x] for x in p}) == 2})


def test_strips_find_the_same_pairs(spark, monkeypatch):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abn") for _ in range(rng.randrange(2, 9))) + rng.choice(["ing", "ion", "x"]) for _ in range(150)} | {"a", "no", "on", "an"})
    sounds = texts._with_sounds(spark.createDataFrame([(w,) for w in words], "word string")).cache()
    a, b = (sounds.select(F.struct("*").alias(n)) for n in "lr")
    side = lambda n: {c: F.col(f"{n}.{c}") for c in ("phonemes", "stress", "syllables")}
    every = a.crossJoin(b).where("l.word < r.word").select("l.word", F.col("r.word").alias("other"), phonetic.similarity(side("l"), side("r")).alias("s"))
    for threshold in (0.9, 0.75):
        expected = {(r["word"], r["other"]): round(r["s"], 6) for r in every.where(F.col("s") >= threshold - 1e-9).collect()}
        for strip in (20_000, 20):
            monkeypatch.setattr(edits, "STRIP", strip)
            rows = pairs.sound_pairs(sounds, threshold).select("l.word", F.col("r.word").alias("other"), "by_phonemes").collect()
            assert len(rows) == len(expected) and {(r["word"], r["other"]): round(r["by_phonemes"], 6) for r in rows} == expected


def test_pairs_that_end_alike_are_compared_in_strips(spark):
    """Not by a join on their ends, which puts all words with a common one into one task and a condition."""
    sounds = texts._with_sounds(spark.createDataFrame([("barring",), ("sparring",)], "word string"))
    plan = pairs.sound_pairs(sounds, 0.9)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
