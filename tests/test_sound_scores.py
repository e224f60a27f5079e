"""Likenesses of many pairs at once: as by the column expressions, in the tasks that compare; distances within bands as by a plain table."""

import random

import numpy as np
import pyarrow as pa

from lexigrid.functions import phonetic
from lexigrid.operators import edits, pairs, sounds
from lexigrid.plans import texts
from pyspark.sql import functions as F
from tests.test_sound_pairs import plain

SCHEMA = "word string, phonemes array<string>, stress string, syllables int, ipa string"


def words(n=70, seed=4):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        said = [rng.choice(["AA1", "AA", "EH2", "T", "N", "NG", "B", "CH", "ZH0"]) for _ in range(rng.choice([1, 2, 3, 4, 7, 12, 25]))]
        out.append((f"w{k}", said, rng.choice(["0", "010", "12", "2" * 23, "0x1", "", "000"]), rng.choice([0, 1, 2, 3, 9]), "".join(rng.choice("ɑtnŋ") for _ in range(rng.choice([0, 1, 2, 6, 11])))))
    return out + [(f"x{w}", p, s, y, i) for w, p, s, y, i in out[: n // 2]]


def test_scores_are_those_of_the_column_expressions(spark):
    rows = words()
    given = spark.createDataFrame(rows, SCHEMA)
    a, b = (given.select(F.struct("*").alias(n)) for n in "lr")
    side = lambda n: {c: F.col(f"{n}.{c}") for c in ("phonemes", "stress", "syllables", "ipa")}
    three = [f(side("l"), side("r")).alias(f.__name__) for f in (phonetic.similarity, phonetic.similarity_fixed, phonetic.similarity_characters)]
    want = {(r[0], r[1]): r[2:] for r in a.crossJoin(b).where("l.word < r.word").select("l.word", "r.word", *three).collect()}
    joined = ["".join(r[1]) for r in rows]
    own = sounds.Sounds(pa.array([r[1] for r in rows], pa.list_(pa.string())), joined, [r[2] for r in rows], np.array([r[3] for r in rows]), [r[4] for r in rows])
    l, r = np.triu_indices(len(rows), 1)
    needed = np.array([plain(joined[x], joined[y]) for x, y in zip(l.tolist(), r.tolist(), strict=True)])
    got = np.stack([own.by_phonemes(l, r, needed), own.by_vectors(l, r), own.by_characters(l, r)], axis=1)
    for x, y, mine in zip(l.tolist(), r.tolist(), got.tolist(), strict=True):
        theirs = want[min(rows[x][0], rows[y][0]), max(rows[x][0], rows[y][0])]
        assert np.allclose(mine, theirs, atol=1e-12), (rows[x], rows[y], mine, theirs)


def test_pairs_of_any_stress_are_those_of_the_formula(spark, monkeypatch):
    given = spark.createDataFrame([(w, p, s, max(y, 1), i) for w, p, s, y, i in words(60, 5)], SCHEMA).cache()
    a, b = (given.select(F.struct("*").alias(n)) for n in "lr")
    side = lambda n: {c: F.col(f"{n}.{c}") for c in ("phonemes", "stress", "syllables", "ipa")}
    every = a.crossJoin(b).where("l.word < r.word").select("l.word", F.col("r.word").alias("other"), phonetic.similarity(side("l"), side("r")).alias("s"))
    monkeypatch.setattr(edits, "STRIP", 9)
    for threshold in (0.9, 0.85, 0.72):
        want = {(r[0], r[1]): round(r[2], 9) for r in every.where(F.col("s") >= threshold - 1e-9).collect()}
        got = [(r["a"], r["b"], round(r["by_phonemes"], 9)) for r in pairs.sound_likenesses(given, threshold).collect()]
        assert len(got) == len(want) and {(x, y): s for x, y, s in got} == want


def test_pairs_leave_their_tasks_scored(spark):
    """Not by array functions over pairs that are joined to their words again, which took most of the time."""
    given = texts._with_sounds(spark.createDataFrame([("barring",), ("sparring",)], "word string"))
    plan = pairs.sound_likenesses(given, 0.9)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("FlatMapGroupsInArrow")]
    assert "Join" not in above and "zip_with" not in plan and "levenshtein" not in plan


def test_bands_and_letters_lose_no_pair(monkeypatch):
    rng = random.Random(6)
    stems = ["".join(rng.choice("AEHNT") for _ in range(rng.randrange(0, 15))) for _ in range(160)]
    said = stems + [s[:k] + rng.choice(["", "A", "NG"]) + s[k + 1 :] for s in stems for k in (0, 2, 5)]
    said = [s + "IHNG" for s in said]
    numbers = np.array([1 + len(s) % 3 for s in said])
    share = lambda m, n: 0.3 - 0.1 * (1 - np.minimum(m, n) / np.maximum(m, n))
    a, b = np.triu_indices(len(said), 1)
    needed = np.array([plain(said[x], said[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    sizes = np.array([len(s) for s in said])
    fits = needed <= np.floor(share(numbers[a], numbers[b]) * np.maximum(sizes[a], sizes[b]))
    want = {frozenset(p): d for *p, d in zip(a[fits].tolist(), b[fits].tolist(), needed[fits].tolist(), strict=True)}
    for together, rows, columns, at_once in ((8_192, 16, 4_096, 1 << 18), (1, 3, 7, 50)):
        for name, value in (("TOGETHER", together), ("ROWS", rows), ("COLUMNS", columns), ("AT_ONCE", at_once)):
            monkeypatch.setattr(edits, name, value)
        for second in (np.zeros(len(said), bool), np.arange(len(said)) % 2 == 1):
            found = [(frozenset((x, y)), d) for l, r, e in edits.Strips(said, numbers, second).measured(share, 0.3) for x, y, d in zip(l.tolist(), r.tolist(), e.tolist(), strict=True)]  # noqa: E741
            kept = {p: d for p, d in want.items() if not second.any() or len({second[x] for x in p}) == 2}
            assert len(found) == len(kept) and dict(found) == kept


def test_texts_that_are_all_alike_or_empty():
    for said in (["NG"] * 5, [""] * 5, ["", "", "A"], ["TA", "A"]):
        n = len(said)
        found = [(x, y, d) for l, r, e in edits.Strips(said, np.ones(n), np.zeros(n, bool)).measured(lambda m, _: 0.5 + 0 * m, 0.5) for x, y, d in zip(l.tolist(), r.tolist(), e.tolist(), strict=True)]  # noqa: E741
        want = {(x, y) for x in range(n) for y in range(x) if plain(said[x], said[y]) <= 0.5 * max(len(said[x]), len(said[y]))}
        assert {(max(x, y), min(x, y)) for x, y, _ in found} == want and all(d == plain(said[x], said[y]) for x, y, d in found)
