"""The pipeline's stages, and the queries over the driver's smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from lexigrid.llm.common import written
from lexigrid.llm.queries import QUERIES
from lexigrid.llm.sql import ORACLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), "stage")
        counts.append(docs.count())
        if name != "sharding":
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] >= counts[3] < counts[4] == counts[5]
    assert {"shard", "slot"} <= set(docs.columns)


def test_stages_on_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), "stage")
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    expected, got = c.execute(ORACLES[name]).df(), QUERIES[name](spark, DATA).toPandas()
    key = expected.columns[0]
    assert set(expected.columns) == set(got.columns)
    assert expected.sort_values(key).reset_index(drop=True).equals(got[list(expected.columns)].sort_values(key).reset_index(drop=True).astype(expected.dtypes.to_dict()))
