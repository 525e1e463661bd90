"""Every registered query against its DuckDB SQL."""

import duckdb
import pytest

from sparkseek import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES.split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(tuple, df.where(df.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir).toPandas()
    if name in catalog.ORACLE_SQL:
        expected = duck.sql(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert _rows(got) == _rows(expected)
    else:
        assert len(got)


def test_flagship(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).count() > 0
