"""Formulas against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from lexigrid.functions import phonetic, scores, text
from lexigrid.operators import analytics, links, pairs, rarity, ranks, state
from lexigrid.sources import files, page_terms


def one(spark, column, **given):
    return spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in given.items())).select(column).first()[0]


def test_percent_rank_keeps_unknown_values(spark):
    df = spark.createDataFrame([(1, 5.0), (2, -999.0), (3, None), (4, 3.0), (5, 3.0)], "id int, x double")
    got = {r["id"]: 1 - r["p"] for r in ranks.with_percent_rank(df, "x", "p").collect()}
    assert got == {1: 0.25, 2: 1.0, 3: 0.0, 4: 0.75, 5: 0.75}


def test_row_number_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")).repartition(7)
    got = ranks.with_row_number(df, [F.col("x").desc()], "n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 1001)) and [r["x"] for r in got] == sorted((r["x"] for r in got), reverse=True)


def test_rank_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ONE_RANGE", 10)
    df = spark.range(3000).select(F.when(F.col("id") % 50 != 0, F.col("id") * 31 % 700).cast("double").alias("x"))
    values = sorted((r["x"] for r in df.collect()), key=lambda v: (v is None, v))
    for r in ranks.with_rank(df, "x", "r").distinct().collect():
        assert r["r"] == values.index(r["x"]) + 1
    down = sorted((v for v in values if v is not None), reverse=True)
    for r in ranks.with_rank(df, "x", "r", descending=True).distinct().where("x IS NOT NULL").collect():
        assert r["r"] == down.index(r["x"]) + 1


def test_rank_of_empty_table(spark):
    assert ranks.with_rank(spark.createDataFrame([], "x double"), "x", "r").count() == 0


def test_blend_of_what_there_is(spark):
    mix = rarity.renormalised([(F.lit(0.8), 0.45), (F.lit(None).cast("double"), 0.35), (F.lit(0.5), 0.20)])
    assert one(spark, mix) == pytest.approx((0.8 * 0.45 + 0.5 * 0.20) / 0.65)
    assert one(spark, rarity.renormalised([(F.lit(None).cast("double"), 0.5)])) is None


def test_bands(spark):
    assert one(spark, rarity.band(F.lit(0.2))) == "somewhat common"
    assert one(spark, rarity.band(F.lit(0.8))) == "ultra-rare"
    assert one(spark, rarity.band(F.lit(None).cast("double"))) is None


def test_histogram_clamps_and_fills(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (0.5,), (None,)], "x double")
    got = {r["bucket"]: r["n"] for r in rarity.histogram(df, "x", 20).collect()}
    assert len(got) == 20 and got[19] == 1 and got[0] == 1 and got[10] == 1 and sum(got.values()) == 3


def test_scores(spark):
    assert one(spark, scores.zipf(F.lit(1), F.lit(1_000_000))) == pytest.approx(0.0)
    assert one(spark, scores.length_frequency(F.lit("running"))) == pytest.approx(0.4)
    assert one(spark, scores.syllables(F.lit("table"))) == 2
    assert one(spark, scores.rule_score(F.lit(0.6))) == pytest.approx(0.451188, abs=1e-6)
    days, ease = scores.next_review(F.lit(2.5), F.lit(6), F.lit(5))
    assert one(spark, days) == 14 and one(spark, ease) == pytest.approx(2.6)
    days, ease = scores.next_review(F.lit(1.4), F.lit(14), F.lit(2))
    assert one(spark, days) == 1 and one(spark, ease) == pytest.approx(1.3)


def test_phonetics(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, phonetic.distance(arr("a", "b", "c"), arr("a", "b", "d"))) == pytest.approx(1 / 3)
    assert one(spark, phonetic.stress_similarity(F.lit("10"), F.lit("1"))) == 1.0
    assert one(spark, phonetic.rhyme(arr("a", "b"), arr("x", "a", "b"))) == 1.0
    assert one(spark, phonetic.syllable_similarity(F.lit(2), F.lit(4))) == 0.5
    assert one(spark, phonetic.to_ipa(arr("HH", "EH1", "L", "OW0"))) == "hˈɛloʊ"
    assert one(spark, phonetic.stress(arr("HH", "EH1", "L", "OW0"))) == "10"
    assert one(spark, phonetic.syllables(arr("HH", "EH1", "L", "OW0"))) == 2
    assert one(spark, phonetic.ipa_phonemes(F.lit("hɛˈloʊ"))) == ["h", "ɛ", "l", "oʊ"]


def test_text_functions(spark):
    assert one(spark, text.obsolescence(F.lit("updated list"))) == "medium"
    assert one(spark, text.obsolescence(F.lit("Obsolete form"))) == "high"
    assert one(spark, text.canonical_pos(F.lit("Verb, transitive"), ("noun", "verb"))) == "verb"
    assert one(spark, text.canonical_pos(F.lit("adjective"), ("noun", "verb"))) is None
    assert one(spark, text.clean_term(F.lit(' 1) "Abactor", '))) == "Abactor"
    assert one(spark, text.clean_definition(F.lit("n. cattle thief [1]"))) == "cattle thief"
    assert one(spark, text.circular(F.lit("quickly"), F.lit("In a quick manner"))) == ["quick"]
    assert one(spark, text.pos_by_rules(F.lit("fool"), F.lit("(rare) to act badly"))) == "VERB"
    assert one(spark, text.without_circular_parts(F.lit("running"), F.lit("moving fast; the act of running"))) == "Moving fast"


def test_composite_zipf(spark):
    z = [(3.0, 0.4, 0.95), (3.2, 0.2, 0.8)]
    from lexigrid.plans.terms import _composite

    mean, trust = _composite([F.lit(v) for v, _, _ in z], [w for _, w, _ in z], [c for _, _, c in z])
    assert one(spark, mean) == pytest.approx(3.066667, abs=1e-6) and one(spark, trust) == 1.0


def test_reliability(spark):
    df = spark.createDataFrame([("w", 0.9, 1), ("w", 0.5, 4)], "k string, r double, tier int")
    assert analytics.reliability(df, "k").first()["reliability"] == pytest.approx(0.851220, abs=1e-6)


def test_prefix_duplicates_and_spellings(spark):
    t = spark.createDataFrame([("running",), ("table",)], "term string")
    k = spark.createDataFrame([("runnin",), ("tablet",), ("tabletops",)], "term string")
    assert {tuple(r) for r in pairs.prefix_duplicates(t, k).collect()} == {("running", "runnin")}
    words = spark.createDataFrame([(w,) for w in ("cat", "cut", "cats", "dog", "act", "at")], "term string")
    assert {tuple(r) for r in pairs.close_spellings(words).collect()} == {("cat", "cut"), ("cat", "cats"), ("at", "cat"), ("act", "at")}


def test_html_pages():
    page = "<p>" + "".join(f"<b>{t}</b> n. {d}<br>" for t, d in [("Abactor", "cattle thief"), ("Abaculus", "mosaic tile"), ("Abaddon", "a place of ruin")] * 4) + "</p>"
    assert ("Abactor", "cattle thief") in page_terms.entries(page) and len(page_terms.entries(page)) == 3
    listed = "<ul>" + "".join(f"<li><a href='#'><b>{t}</b></a> — {d}</li>" for t, d in [("Abactor", "cattle thief"), ("Abaculus", "mosaic tile"), ("Abaddon", "a place of ruin")]) + "</ul>"
    assert [t for t, _ in page_terms.entries(listed)] == ["Abactor", "Abaculus", "Abaddon"]
    assert page_terms.entries("<p>Abactor n. cattle thief</p><p>Abaculus n. mosaic tile</p>") == [("Abactor", "cattle thief"), ("Abaculus", "mosaic tile")]
    assert page_terms.entries("<dl><dt>Term</dt><dd>some long meaning</dd></dl><table><tr><th>Meaning</th><th>Word</th></tr><tr><td>another meaning</td><td>Word</td></tr></table>") == [("Term", "some long meaning"), ("Word", "another meaning")]
    assert page_terms.entries(None) == []


def test_greedy_links(spark):
    terms = spark.createDataFrame([(1, "ice cream"), (2, "cream"), (3, "cream soda bar"), (4, "ice")], "id long, term string")
    texts = spark.createDataFrame([(9, "Ice cream soda bar, cream!")], "id long, text string")
    got = links.greedy_links(links.matches(texts, links.term_keys(terms, "id", "term"), "id", "text"))
    assert {(r["at"], r["size"], r["id"]) for r in got.collect()} == {(0, 2, 1), (4, 1, 2)}


def test_alike_groups(spark):
    df = spark.createDataFrame([(1, 1, "a b c d"), (1, 2, "x y z"), (1, 3, "a b c e"), (1, 4, "e c q")], "k long, n long, text string")
    assert {r["n"]: r["group"] for r in links.group_alike(df, "k", "n", "text").collect()} == {1: 0, 2: 1, 3: 0, 4: 0}


def test_ngram_files(spark, tmp_path):
    path = f"{tmp_path}/n.txt"
    with open(path, "w") as f:
        f.write("word\t2000\t3\t1\nword\t2001\t4\t2\nother\t2000,5,1\t2001,6,2\nbad line\n")
    rows = files.read_ngrams(spark, path)
    assert {(r["word"], r["year"], r["matches"]) for r in rows.collect()} == {("word", 2000, 3), ("word", 2001, 4), ("other", 2000, 5), ("other", 2001, 6)}
    assert {r["word"]: r["n"] for r in files.ngram_totals(rows, 8).collect()} == {"other": 11}


def test_dump(spark, tmp_path):
    path = f"{tmp_path}/d.xml"
    with open(path, "w") as f:
        f.write('<mediawiki><page><title>A</title><revision><text bytes="3">abc</text></revision></page><page><title>B</title><revision><text bytes="1">d</text></revision></page></mediawiki>')
    assert {tuple(r) for r in files.read_dump(spark, path).collect()} == {("A", "abc"), ("B", "d")}


def test_folds(spark):
    rows = [(1, "w", i, f"2024-01-{i + 1:02d} 00:00:00", i != 2) for i in range(8)]
    df = spark.createDataFrame(rows, "user_id long, word string, event_id long, ts string, correct boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    from lexigrid.streaming.activity import mastery_step

    now = ("learning", 0, 0, 0, 2.5, 1)
    for *_, ok in rows:
        now = mastery_step(now, ok)
    got = state.mastery(df, ["user_id", "word"]).first()
    assert (got["level"], got["total"], got["correct"], got["streak"], got["days"]) == (now[0], now[1], now[2], now[3], now[5]) and got["ease"] == pytest.approx(now[4])
    assert state.schedule(df, ["user_id", "word"]).first()["total"] == 8
    assert state.cards(df, ["user_id", "word"]).first()["studied"] == 8
