"""Tables, shared scratch folders and derived inputs."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='lexigrid-')}"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name below the cluster's shared folder, spark.checkpoint.dir of the session.

    Only on a local master, where it may be unset, is a temporary folder of this machine used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/lexigrid/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tokens(docs: DataFrame, *keep: str) -> DataFrame:
    """keep and word: lower-case words of letters only, two at least, split at white space.

    What is neither is taken out of the whole text first, which costs less than word by word.
    """
    return docs.select(*keep, F.explode(_split()).alias("word")).where(F.length("word") > 1)


def _split() -> Column:
    return F.split(F.regexp_replace(F.lower("text"), r"[^\p{L} \t\n\r\f]+", ""), r"[ \t\n\r\f]+")


def tokens_once(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, word, again: the same, with again = 0, and each of a text's words once more, with again = 1.

    So texts that hold a word can be counted by sums of their words, without a distinct of texts and words.
    """
    split = docs.select(*keep, _split().alias("__words"))
    each = lambda words, again: F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(again).alias("again")))
    marked = split.select(*keep, F.explode(F.concat(each(F.col("__words"), 0), each(F.array_distinct("__words"), 1))).alias("__w"))
    return marked.select(*keep, "__w.word", "__w.again").where(F.length("word") > 1)


#: Every term is looked up in three corpora, dealt by the number of a document's source.
CORPORA = ("freq_a", "freq_b", "freq_c")
NOT_FOUND = -999.0
#: Terms longer than this aren't looked up in the third corpus.
UNCHECKED_LENGTH = 14


def lexicon(docs: DataFrame) -> DataFrame:
    """term, total, freq_a, freq_b, freq_c: counts per corpus; NOT_FOUND if it has none, null if unchecked."""
    corpus = F.pmod(F.regexp_extract("source", r"(\d+)", 1).cast("int"), F.lit(3))
    counted = tokens(docs.withColumn("corpus", corpus), "corpus").groupBy("word").agg(F.count("*").alias("total"), *(F.count_if(F.col("corpus") == i).alias(f"n{i}") for i in range(3)))
    found = lambda i: F.when(F.col(f"n{i}") > 0, F.col(f"n{i}").cast("double")).otherwise(NOT_FOUND)
    return counted.select(F.col("word").alias("term"), "total", found(0).alias("freq_a"), found(1).alias("freq_b"), F.when(F.length("word") <= UNCHECKED_LENGTH, found(2)).alias("freq_c"))
