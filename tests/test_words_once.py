"""Queries over the documents' words: texts are split once, words are read once, texts with a word are counted without a distinct."""

from pyspark.sql import functions as F

from lexigrid.plans import texts
from lexigrid.sources.tables import tokens, tokens_once

ROWS = [(1, "the cat the Cat, a dog"), (2, "the dog\nruns"), (3, None), (4, "  "), (6, "cat the-cat"), (7, "die Straße die")]


def documents(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return docs


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_read_once_each(spark, tmp_path):
    """The filter on phonemes isn't moved before the distinct, where every occurrence would be read."""
    documents(spark, tmp_path)
    found = texts._lexicon_sounds(spark, str(tmp_path))
    assert "Aggregate" not in plan(found) and "Generate" not in plan(found)
    assert {r["word"] for r in found.collect()} == {"the", "cat", "thecat", "dog", "runs", "die"}


def test_texts_with_a_word_by_sums(spark, tmp_path):
    docs = documents(spark, tmp_path)
    by_sums = tokens_once(docs, "doc_id").groupBy("word").agg(F.count_if(F.col("again") == 0).alias("n"), F.sum("again").alias("v"))
    by_distinct = tokens(docs, "doc_id").groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("v"))
    assert sorted(map(tuple, by_sums.collect())) == sorted(map(tuple, by_distinct.collect()))


def test_zipf_splits_texts_once(spark, tmp_path):
    documents(spark, tmp_path)
    found = texts.ngram_zipf(spark, str(tmp_path))
    assert "Generate" not in plan(found)
    assert {r["word"] for r in found.collect()} == {"the", "dog"}
