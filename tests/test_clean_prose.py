"""Decomposition by runs: as of whole texts, and little text goes to Python."""

import unicodedata

from lexigrid.functions import entries
from pyspark.sql import functions as F

TEXTS = ["plain", "", None, "\u00e9t\u00e9 \u00e0 No\u00ebl", "\u00e9", "a\u00e9\nb\u00fc", "\ufdfa x \u037a", "\uff76\uff9e \u00e9\uff9e", "x\u0323\u0307 \U0001d400\U0001d401 end\u00e9", "\ud55c\uad6d\uc5b4", "two\n\nlines \u00e4\u00f6"]


def test_runs_as_whole_texts(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", entries.decomposed_runs(F.col("t")).alias("d")).collect()
    assert [r["d"] for r in rows] == [None if t is None else unicodedata.normalize("NFKD", t) for t in TEXTS]


def test_only_runs_go_to_python(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(entries, "decomposed", lambda c: (sent.append(c), c)[1])
    text = spark.createDataFrame([("\u00e9t\u00e9 " + "word " * 1_000,)], "t string")
    entries_of = entries.clean_prose(F.col("t"))
    assert text.select(F.length(sent[0])).first()[0] == 3
    assert text.select(F.length(entries_of)).first()[0] > 4_000
