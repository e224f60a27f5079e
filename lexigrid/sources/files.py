"""Other file formats: delimited text, JSON lines, n-gram counts, word vectors, XML dumps."""

from __future__ import annotations

from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexigrid.sources.tables import written


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("sep", "\t").csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", "\t").csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a schema; fields that a line lacks are null, lines that aren't records are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """A JSON record a line; nulls are left out, other scripts stay as they are."""
    df.write.json(path)


def read_ngrams(spark: SparkSession, path: str) -> DataFrame:
    """word, year, matches, volumes from lines of either form: word, year, counts; or word and groups year,counts."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("p")).where(F.size("p") >= 2)
    long = parts.where(~F.contains(F.col("p")[1], F.lit(","))).select(F.col("p")[0].alias("word"), *(F.expr(f"try_cast(get(p, {i}) AS bigint)").alias(n) for i, n in ((1, "year"), (2, "matches"), (3, "volumes"))))
    groups = parts.where(F.contains(F.col("p")[1], F.lit(","))).select(F.col("p")[0].alias("word"), F.explode(F.slice("p", F.lit(2), F.size("p"))).alias("g")).select("word", F.split("g", ",").alias("g"))
    wide = groups.select("word", *(F.expr(f"try_cast(get(g, {i}) AS bigint)").alias(n) for i, n in ((0, "year"), (1, "matches"), (2, "volumes"))))
    return long.unionByName(wide).where("year IS NOT NULL AND matches IS NOT NULL")


#: Words that are put into the filter of a lookup; more are joined.
LISTED = 10_000


def write_ngrams(ngrams: DataFrame, path: str) -> None:
    """An index by first letter, sorted by word in each file: a lookup reads the folders and row groups that it needs only."""
    ngrams.withColumn("initial", F.lower(F.substring("word", 1, 1))).repartitionByRange("initial", "word").sortWithinPartitions("initial", "word").write.partitionBy("initial").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """word, year, matches and initial of an index."""
    return spark.read.schema("word string, year long, matches long, volumes long, initial string").parquet(path)


def indexed_lookup(index: DataFrame, words: DataFrame, word_col: str = "word", listed: int = LISTED) -> DataFrame:
    """word, year, matches of the words, as they are written in the index.

    So many words at most become filters on folders and row groups. More are joined on letter and word, and Spark
    prunes folders by the letters that the words have. Words without entry give no rows; null and repeated ones don't matter.
    """
    asked = words.select(F.col(word_col).alias("word")).where("word IS NOT NULL AND word <> ''").distinct()
    some = [r[0] for r in asked.limit(listed + 1).collect()]
    if len(some) <= listed:
        initials = sorted({w[0].lower() for w in some})
        return index.where(F.col("initial").isin(initials) & F.col("word").isin(some)).select("word", "year", "matches")
    keyed = asked.withColumn("initial", F.lower(F.substring("word", 1, 1)))
    return index.join(keyed, ["initial", "word"]).select("word", "year", "matches")


def ngram_totals(ngrams: DataFrame, least: int = 1) -> DataFrame:
    """Uses of each word in all years: summed in each task, then over the shuffle."""
    return ngrams.groupBy(F.lower("word").alias("word")).agg(F.sum("matches").alias("n")).where(F.col("n") >= least)


def mean_zipf(ngrams: DataFrame, totals: DataFrame, alpha: float = 1e-6) -> DataFrame:
    """word, zipf: the mean over all years of log10 of its share per million, years without it included."""
    years = totals.select("year", F.col("total").cast("double"))
    words = ngrams.select("word").distinct()
    grid = words.crossJoin(F.broadcast(years))  # a row per year: a few hundred
    joined = grid.join(ngrams.groupBy("word", "year").agg(F.sum("matches").alias("matches")), ["word", "year"], "left")
    share = F.coalesce("matches", F.lit(0)) / F.col("total") + alpha
    return joined.groupBy("word").agg(F.avg(F.log10(share * 1e6)).alias("zipf"))


def read_vectors(spark: SparkSession, path: str, most: int | None = 500_000) -> DataFrame:
    """word, rank from text files of word vectors in order of frequency; the least rank of equal words, header left out.

    Ranks count lines over all files in order of their names: a line's place in its stretch of a file, after the lines of the
    stretches before it. Spark may deal stretches to partitions in any order.
    """
    at = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    words = spark.read.text(path).select(F.split("value", " ", 2)[0].alias("word"), F.size(F.split("value", " ")).alias("n"), *at).where("n > 2")
    lines = written(words.select("word", "file", "start", F.monotonically_increasing_id().alias("id")), "vector-words")
    sizes = lines.groupBy("file", "start").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)  # a row per stretch of a file
    offsets = sizes.select("file", "start", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("least")).alias("offset"))
    ranked = lines.join(F.broadcast(offsets), ["file", "start"]).select(F.lower("word").alias("word"), (F.col("offset") + F.col("id") + 1).alias("rank"))
    kept = ranked if most is None else ranked.where(F.col("rank") <= most)
    return kept.groupBy("word").agg(F.min("rank").alias("rank"))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """title, text of the pages of a wiki dump."""
    schema = "title string, revision struct<text: struct<_VALUE: string>>"
    raw = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return raw.select("title", F.col("revision.text._VALUE").alias("text"))


def write_dump(pages: DataFrame, path: str) -> None:
    """Pages (title, text) as XML files that `read_dump` reads: one root for each, as parsers stop after the first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = lambda x: pa.RecordBatch.from_arrays([pa.array(x, pa.string())], ["value"])
        yield lines(["<mediawiki>"])
        for batch in batches:
            yield lines([f"<page><title>{escape(t or '')}</title><revision><text>{escape(x or '')}</text></revision></page>" for t, x in zip(*(c.to_pylist() for c in batch.columns), strict=True)])
        yield lines(["</mediawiki>"])

    pages.select(F.col("title").cast("string"), "text").mapInArrow(rows, "value string").write.text(path)


def lookup(terms: DataFrame, scores: DataFrame, not_found: float = -999.0) -> DataFrame:
    """terms with score, not_found if the table has none."""
    return terms.join(scores.select(F.lower("word").alias("__w"), "score"), F.lower("term") == F.col("__w"), "left").drop("__w").withColumn("score", F.coalesce("score", F.lit(not_found)))
