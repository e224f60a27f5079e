"""Merkle manifest, collocations and near vectors against plain Python, with the odd cases."""

import math
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import merkle, phrases, ranking, vectors

FIELDS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, h int, g int, rank string"


def manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], FIELDS).repartition(3)
    found = merkle.manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0, keep=["doc_id", "leaf", "h", "rank"])
    assert found.columns == ["doc_id", "h", "rank", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in found.drop("h", "rank").collect()), key=str)


def odd_rows():
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(300)] + [(i, f"s{i % 40}", None, None, f"Other {i}") for i in range(300, 420)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (7, None, "de", 0, ""), (7, None, "de", 0, ""), (-5, "Å", "x", 1, "ÄÖ Zz"), (11, "", "x", 1, "A" * 200_000)]
    return rows + [(1000, "one", "en", 1, "alone")]


def test_manifest(spark):
    rows = odd_rows()
    assert manifest(spark, rows) == sorted(brute.merkle(rows), key=str)
    assert manifest(spark, rows[:1]) == brute.merkle(rows[:1])
    assert manifest(spark, rows[:17]) == sorted(brute.merkle(rows[:17]), key=str)
    assert manifest(spark, []) == []


def test_manifest_in_small_blocks(spark, monkeypatch):
    """Several rounds of blocks, and ranks over several ranges."""
    monkeypatch.setattr(merkle, "DEPTH", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    monkeypatch.setattr(ranking, "RANGE_ROWS", 50)
    assert manifest(spark, odd_rows()) == sorted(brute.merkle(odd_rows()), key=str)


def test_manifest_tells_tampered_rows(spark):
    found = manifest(spark, odd_rows())
    assert {r[6] for r in found} == {True, False} and len({r[3] for r in found}) == 1


def said():
    rng = random.Random(5)
    words = ["the", "of", "New", "york", "city", "Ünder", "日本", "a", "b", "x.y"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(30))) + rng.choice([".", "!", "\n", " ", ""]), rng.choice(["en", "de", None])) for _ in range(200)]
    rows += [("NEW york\tcity, new york city;new york city", "en")] * 30 + [(None, "en"), ("", None), ("  \t ", "en"), ("z" * 300_000, "en")]
    rows += [("one two three four five six " * 20, "fr"), ("q " * 5_000, "fr"), (" no break here \x1f", "en")]
    return rows


def collocated(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, num int, n int").repartition(3)
    return {tuple(r) for r in phrases.collocations(docs, **more).collect()}


@pytest.mark.parametrize("at_once", [3, phrases.TRIE])
def test_collocations(spark, at_once):
    found = collocated(spark, said(), least=8, at_once=at_once)
    assert found == brute.collocations(said(), 8) and len(found) > 50


def test_best_collocations_ties_and_nothing(spark):
    assert collocated(spark, said(), least=5, top=4) == brute.collocations(said(), 5, 4)
    assert collocated(spark, [], least=2) == collocated(spark, said(), least=10**6) == set()
    assert collocated(spark, [("a b c", "en")], least=1) == brute.collocations([("a b c", "en")], 1)


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "TEXT_BYTES", 50)
    monkeypatch.setattr(phrases, "WORDS", 7)
    given = [(t, lang) for t, lang in said() if len(t or "") < 5_000]
    assert collocated(spark, given, least=8) == brute.collocations(given, 8)


def test_scores_beyond_64_bits(spark):
    a, n, left, right = 9 * 10**12, 10**15, 10**13, 10**13 + 7
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").select(phrases._score(*map(F.col, "anlr")).alias("s")).first()
    assert row["s"] == 1000 * a * n // (left * right)


def test_trie_finds_what_it_holds():
    rng = np.random.default_rng(1)
    rows = np.unique(rng.integers(1, 60, (3_000, 3)), axis=0)
    numbers = np.arange(1, len(rows) + 1)
    trie = phrases.build_trie(rows, numbers)
    ids = rng.integers(0, 62, 20_000)
    known = {tuple(r): n for r, n in zip(rows.tolist(), numbers.tolist(), strict=True)}
    assert trie.find(ids).tolist() == [known.get(tuple(ids[k : k + 3].tolist()), 0) for k in range(len(ids))]


def bunches():
    """A tight group, a loose one, a chain, copies, scaled copies, and vectors of no use."""
    rng = np.random.default_rng(3)
    at, out = rng.standard_normal((4, 24)), []
    out += [at[0] + 0.05 * rng.standard_normal(24) for _ in range(120)] + [at[1] + 0.22 * rng.standard_normal(24) for _ in range(60)]
    angle = [0.3 * k for k in range(8)]
    out += [math.cos(x) * np.eye(24)[0] + math.sin(x) * np.eye(24)[1] for x in angle] + [at[2]] * 9 + [at[2] * 2.5, at[2] * 1e-200, at[2] * 1e150, -at[2]]
    out += list(rng.standard_normal((60, 24)))
    rows = [(i * 3 % 1000, v.tolist()) for i, v in enumerate(out)]
    rows += [(2001, None), (2002, []), (2003, [0.0] * 24), (2004, [math.nan] * 24), (2005, [math.inf] + [1.0] * 23), (2006, [None] + [1.0] * 23)]
    return rows + [(2007, at[3][:7].tolist()), (2008, at[3][:7].tolist()), (None, at[0].tolist()), (None, [1.0, -5.0]), (None, None), (rows[0][0], rows[0][1])]


def near(spark, rows, **more):
    given = spark.createDataFrame([(i, v, "x", 5) for i, v in rows], "vec_id long, embedding array<double>, node string, n_links int").repartition(3)
    found = vectors.near_vectors(given, keep=["vec_id", "node", "n_links"], **more)
    assert found.columns == ["vec_id", "node", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in found.drop("node").collect()), key=str)


def test_near_vectors(spark):
    assert near(spark, bunches()) == brute.near_vectors(bunches(), 0.95)


def test_near_vectors_in_small_parts(spark, monkeypatch):
    for name, value in (("CHUNK", 5), ("CELL", 3), ("KEY_BITS", 4)):
        monkeypatch.setattr(vectors, name, value)
    assert near(spark, bunches()) == brute.near_vectors(bunches(), 0.95)


def test_no_vectors(spark):
    assert near(spark, []) == [] and near(spark, [(1, None), (2, [0.0])]) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_tables_follow_from_recall():
    for n in (10, 10_000, 10**9):
        bits, tables = vectors.plan(n)
        assert (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables <= 1 - vectors.RECALL
