import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

PROSE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from old trees near a quiet river that runs past green hills"
LONG = " ".join(f"word{i % 977} other{i % 31}" for i in range(30_000))


def texts():
    """Nulls, empties, a long text, ties, repeats, odd scripts."""
    rows = [
        (1, PROSE, "a"),
        (2, PROSE, "a"),
        (3, PROSE.upper(), "b"),
        (4, None, "b"),
        (5, "", None),
        (6, " \t\n ", None),
        (7, LONG, "a"),
        (8, PROSE.replace("seven", "nine"), "c"),
        (9, "one two", "c"),
        (10, "Straße Été ÑANDÚ İstanbul Kelvin 日本 語", "c"),
        (11, "line\nline\nother line\nline\n" + PROSE, "d"),
        (12, " ".join([PROSE] * 3), "d"),
        (13, "$$$ *** ### " * 20 + PROSE, "d"),
        (14, "Licensed under the MIT license. See the Apache License, Version 2.0 and CC-BY-NC 4.0; under the GPL v3.", "e"),
        (14, "Licensed under the MIT license. See the Apache License, Version 2.0 and CC-BY-NC 4.0; under the GPL v3.", "e"),
        (None, PROSE + " end", "e"),
        (None, None, "e"),
    ]
    return rows + [(100 + i, f"{PROSE} {i} " + " ".join(f"w{(i * 7 + k) % 50}" for k in range(i % 40)), f"s{i % 5}") for i in range(60)]


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With other columns, some of which have the names that the operators give."""
    full = [(i, t, s, "x", 1.0, True, 5) for i, t, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, source string, shard string, score double, kept boolean, size int").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")
