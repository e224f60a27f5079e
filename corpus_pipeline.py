"""A training corpus from raw documents: each stage calls one of the corpus operators.

Rejected documents go, one document of each near-duplicate group stays, documents that hold benchmark
passages go, sources are brought to their target weights, and what is left is put into shards.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigrid.llm import decontaminate, mixing, quality, sharding, simhash
from lexigrid.llm.common import STAGE_FOLDER, boxed, discard, scratch, table

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
#: Session setting: the scratch folder of the stage before.
BEFORE = "spark.lexigrid.stageBefore"


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def stage(f: Stage) -> Stage:
    """A stage's result has to be written before the session's next stage is called, as run() does.

    What the stage before wrote for itself is then of no use, and is deleted. Both folders are settings of
    the session, so pipelines in different sessions don't meet.
    """

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if before := spark.conf.get(BEFORE, None):
            discard(spark, before)
        folder = scratch(spark, "stage")
        spark.conf.set(BEFORE, folder)
        spark.conf.set(STAGE_FOLDER, folder)
        try:
            return f(spark, docs, sf_dir)
        finally:
            spark.conf.unset(STAGE_FOLDER)

    return run_stage


def _row(docs: DataFrame, *more: str) -> DataFrame:
    """The row as a struct, __in, and the columns that an operator reads: so no name of the input's can clash with its own."""
    return docs.select(boxed(docs), *more)


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep. Null and empty texts go, as they fail the base rule."""
    return quality.judge(_row(docs, "text"), keep=["__in"]).where("kept").select("__in.*")


@stage
def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (0.8 of five-word shingles), that with the least id.

    Texts without words are copies of each other; of repeated rows one stays.
    """
    return simhash.drop_near_copies(docs)


@stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none. Repeated rows are judged alike."""
    found = decontaminate.find_leaks(_row(docs, "text"), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("__items") == 0).select("__in.*")


@stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target says; copies are rows of their own. A null source is one more source."""
    return mixing.emit(mixing.mix_to_targets(_row(docs, "doc_id", "text", "source"), keep=["__in"])).select("__in.*")


@stage
def shard_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with size, text_crc32, shard and slot, which replace columns of these names. Null texts have size 1."""
    return sharding.shuffle_into_shards(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("sharding", shard_rows),
]

#: Quality rules fit a model, SimHash needs XXH64 and sharding draws at random: SQL expresses none of these.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, from the table of documents."""
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT)
    for name, step in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
