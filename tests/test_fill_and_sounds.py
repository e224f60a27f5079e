"""Reading rules, circular repair, the plan of what is filled in, and lookups in a pruned index."""

import random

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import phonetic, text
from lexigrid.operators import correction, links, planner
from lexigrid.sources import files


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def read(word):
    """ARPAbet by going through the letters."""
    plain = {"b": "B", "c": "K", "d": "D", "f": "F", "g": "G", "h": "HH", "i": "IH", "j": "JH", "k": "K", "l": "L", "m": "M", "n": "N", "o": "AA", "p": "P", "q": "K", "r": "R", "s": "S", "t": "T", "u": "AH", "v": "V", "w": "W", "x": "K S", "y": "Y", "z": "Z"}
    word, out, i = word.lower(), [], 0
    while i < len(word):
        two, last = word[i : i + 2], i == len(word) - 1
        if two in ("ch", "sh", "ph"):
            out.append({"ch": "CH", "sh": "SH", "ph": "F"}[two])
        elif two == "th":
            out.append("DH" if i == 0 or word[i - 1] in "aeiou" else "TH")
        elif two == "gh":
            out += ["G"] * (i < len(word) - 2)
        elif word[i] == "a":
            out.append("AH" if last else "AE")
        elif word[i] == "e":
            out += ["EH"] * (not last)
        else:
            out += plain.get(word[i], "").split()
        i += 2 if two in ("ch", "sh", "th", "ph", "gh") else 1
    return out


def test_words_are_read(spark):
    rng = random.Random(3)
    words = ["the", "earth", "path", "sigh", "ghost", "tax", "phase", "Chimera", "e", "a", "x", "", "don't", "th-th", "ñu", "line\nth"]
    words += ["".join(rng.choice("acehgpstx") for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    got = spark.createDataFrame([(w,) for w in words], "word string").select("word", phonetic.phonemes(F.col("word")).alias("p")).collect()
    assert {r["word"]: r["p"] for r in got} == {w: read(w) for w in words}
    assert one(spark, phonetic.phonemes(F.lit(None).cast("string"))) is None
    ship = phonetic.phonemes(F.lit("ships"))
    assert (one(spark, phonetic.to_ipa(ship)), one(spark, phonetic.stress(ship)), one(spark, phonetic.syllables(ship))) == ("ʃɪps", "0", 1)


@pytest.mark.parametrize(
    "word, definition, repaired",
    [
        ("fable", "of, relating to, or of the nature of fable; a short tale", "A short tale"),
        ("hunter", "one who hunts, a hunter, the hunters;", "One who hunts;"),
        ("quickly", "in a quick manner, at once", "In manner, at once"),
        ("wily", "wily: in a wiry manner, said the wily", "Wily: , said"),
        ("ably", "ably, in a table manner; well", "Ably; well"),
        ("quickly", "in a rather quick manner", "In a rather quick manner"),
        ("cat", "a small animal", "A small animal"),
        ("cat", "the cat", ""),
        ("cat", None, None),
        ("ñandú", "un ave; the Ñandú of the south", "Un ave; of the south"),
    ],
)
def test_circular_repair(spark, word, definition, repaired):
    assert one(spark, text.repaired(F.lit(word), F.lit(definition).cast("string"))) == repaired


def plan(spark, rows, found, filled=()):
    out = planner.plan_fill(
        spark.createDataFrame(rows, "id long, term string, pos string"),
        spark.createDataFrame(found, "term string, pos string, text string, source string, reliability double"),
        spark.createDataFrame(list(filled), "term string, pos string"),
    )
    return sorted((tuple(r)[:5] for r in out.collect()), key=str)


def test_what_is_filled_in(spark):
    rows = [(1, "Mole", "noun"), (2, "mole", "noun"), (3, "mole", None), (4, "MOLE", None), (5, "mole", "pronoun"), (6, "vole", None), (7, None, "noun"), (8, None, None)]
    found = [("mole", "noun", "animal", "b", 0.9), ("mole", "noun", "spot", "a", 0.9), ("mole", "noun", "mass", "c", 0.5), ("mole", "verb", "to dig", "a", 0.7), ("Mole", "adjective", "dark", "a", 0.8), ("mole", "adverb", "darkly", "a", 0.1), ("mole", "particle", "?", "a", 0.05), ("mole", None, "-", "a", 1.0), ("hare", "noun", "animal", "a", 1.0)]
    expected = [
        ("update", 1, "mole", "noun", "spot"),
        ("skip", 2, "mole", "noun", None),
        ("update", 3, "mole", "adjective", "dark"),
        ("update", 4, "mole", "verb", "to dig"),
        ("skip", 5, "mole", "pronoun", None),
        ("skip", 6, "vole", None, None),
        ("skip", 7, None, "noun", None),
        ("skip", 8, None, None, None),
    ]
    assert plan(spark, rows, found) == sorted([*expected, ("insert", None, "mole", "adverb", "darkly"), ("insert", None, "mole", "particle", "?")], key=str)
    assert plan(spark, rows, found, [("MOLE", "adverb"), ("vole", "noun")]) == sorted([*expected, ("insert", None, "mole", "particle", "?")], key=str)
    assert plan(spark, [], found) == [] and {a[0] for a in plan(spark, rows, [])} == {"skip"}


def test_lookups_read_what_they_need(spark, tmp_path):
    rows = [(w, 2000 + y, len(w) + y, 1) for w in ("apple", "Ant", "berry", "cat", "çedilla", "dog", "it's") for y in range(3)]
    files.write_ngrams(spark.createDataFrame(rows, "word string, year long, matches long, volumes long"), f"file://{tmp_path}/index")
    index = files.read_index(spark, f"file://{tmp_path}/index")
    asked = spark.createDataFrame([("Ant",), ("cat",), ("cat",), (None,), ("",), ("çedilla",), ("it's",), ("none",)], "word string")
    expected = sorted(r[:3] for r in rows if r[0] in ("Ant", "cat", "çedilla", "it's"))
    few, many = files.indexed_lookup(index, asked), files.indexed_lookup(index, asked, listed=2)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == expected
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in (few, many)]
    assert "PartitionFilters: [initial" in plans[0].replace("isnotnull(initial", "initial") and "In(word" in plans[0]
    assert "dynamicpruning" in plans[1].lower()
    read_ = {r[0].rsplit("initial=", 1)[1].split("/")[0] for r in few.select(F.input_file_name()).distinct().collect()}
    assert read_ <= {"a", "c", "i", "%C3%A7", "ç", "n"}
    assert files.indexed_lookup(index, asked.where("false")).count() == 0


def test_longest_terms_in_blocks(spark):
    rng = random.Random(5)
    words = ["new", "york", "city", "hall", "new york", "york city", "new york city", "city hall of", "ox"]
    texts = [(i, " ".join(rng.choice("new york city hall of ox".split()) for _ in range(rng.randrange(30)))) for i in range(60)] + [(60, None), (61, "")]
    keys = links.term_keys(spark.createDataFrame(list(enumerate(words)), "id long, term string"), "id", "term")
    docs = spark.createDataFrame(texts, "id long, text string")
    terms = {tuple(w.split()): i for i, w in enumerate(words) if any(len(x) >= 3 for x in w.split())}
    expected = set()
    for i, t in texts:
        said = (t or "").split()
        for at in range(len(said)):
            best = max((n for n in (1, 2, 3) if tuple(said[at : at + n]) in terms and at + n <= len(said)), default=0)
            if best:
                expected.add((i, at, best, terms[tuple(said[at : at + best])]))
    for at_once in (2, 100):
        assert {tuple(r) for r in links.matches(docs, keys, "id", "text", at_once=at_once).collect()} == expected


def test_smart_corrections(spark):
    known = [("fable", "a short tale with a moral at the end"), ("Fable", "a longer tale that has a moral, too"), ("cat", "a cat is a cat, as everybody knows"), ("dog", "too short"), ("cash", r"money in coins and notes, $1 or C:\x for one"), ("none", None), (None, "a long enough definition of nothing")]
    entries = [
        (1, "mole", "a small animal"),
        (2, "fable", "a fable; a short tale with a moral"),
        (3, "fable", "the fable"),
        (4, "cat", "a cat, pet"),
        (5, "dog", "the dog"),
        (6, "dog", "of, relating to, or of the nature of dog and of other animals"),
        (7, "cash", "Cash or cashes"),
        (8, None, "x"),
        (9, "x", None),
    ]
    got = correction.smart_corrections(spark.createDataFrame(entries, "id long, term string, definition string"), spark.createDataFrame(known, "term string, definition string"))
    assert {tuple(r) for r in got.collect()} == {
        (1, "a small animal", "none"),
        (2, "A short tale with a moral", "parts"),
        (3, "the a longer tale that has a moral, too", "substituted"),
        (4, "Pet", "parts"),
        (5, "the dog", "unchanged"),
        (6, "Of; relating to", "parts"),
        (7, r"money in coins and notes, $1 or C:\x for one or cashes", "substituted"),
        (8, "x", "none"),
        (9, None, "none"),
    }
