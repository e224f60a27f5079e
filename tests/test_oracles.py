"""Every query with an oracle, over the driver's smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lexigrid.plans import entries, frames, profiles, terms, texts, upkeep

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = terms.QUERIES | frames.QUERIES | texts.QUERIES | entries.QUERIES | upkeep.QUERIES | profiles.QUERIES
ORACLES = terms.ORACLES | frames.ORACLES | texts.ORACLES | entries.ORACLES | upkeep.ORACLES | profiles.ORACLES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def normal(df: pd.DataFrame) -> list[tuple]:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if str(out[c].dtype).startswith("datetime") or out[c].map(lambda v: hasattr(v, "isoformat")).any():
            out[c] = out[c].map(lambda v: "" if pd.isna(v) else str(pd.Timestamp(v)))
        elif out[c].dtype.kind in "if":
            out[c] = out[c].astype(float).round(7)
    return sorted(map(tuple, out.astype(str).to_numpy().tolist()))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    assert normal(QUERIES[name](spark, DATA).toPandas()) == normal(duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).toPandas() is not None


def test_entry_has_all(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
