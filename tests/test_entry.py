"""Every query with SQL gives its rows, over the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from tessera.plans import queries as documents

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def rows(df):
    plain = lambda v: None if not isinstance(v, list) and pd.isna(v) else float(v) if isinstance(v, (int, float)) or hasattr(v, "item") else v
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(documents.oracle_sql()))
def test_same_rows_as_sql(spark, sql, name):
    assert rows(__spark_entry__.queries()[name](spark, DATA).toPandas()) == rows(sql.sql(__spark_entry__.oracle_sql()[name]).df())


def test_stress_outcomes(spark):
    found = __spark_entry__.queries()["q34_stress"](spark, DATA).collect()
    assert len(found) == 16
    for r in found:
        assert r["stage"] == r["expected_stage"]
        assert r["expected_stage"] is not None or r["emitted_rdf_quads"] == r["expected_quads"]
