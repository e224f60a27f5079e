"""Helpers shared by the corpus operators: tables, shared scratch folders, word patterns."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ASCII white space, and a word of anything else.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


#: Session setting: where scratch folders go while it is set, so that they can be deleted together.
STAGE_FOLDER = "spark.lexigrid.stageFolder"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='lexigrid-')}"


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name below the cluster's shared folder.

    spark.checkpoint.dir comes from the session. Only on a local master, where it may be unset, is a
    temporary folder of this machine used; a cluster without that setting is refused.
    """
    base = spark.conf.get(STAGE_FOLDER, None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/lexigrid/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing will read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def boxed(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The input's columns as one struct, __in, so that none of their names can clash with an operator's own."""
    columns = df.columns if columns is None else columns
    return (F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.expr("named_struct()")).alias("__in")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the parts; the same on any engine."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
