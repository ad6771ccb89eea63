"""Every registered query of the engine against its DuckDB text on the smallest tables."""

import duckdb
import pytest

from tangency.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_duckdb(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, FOLDER).toPandas()
    wanted = duck.sql(catalogue.ORACLES[name]).df()
    columns = sorted(wanted.columns)
    assert sorted(ours.columns) == columns
    sides = [d[columns].astype(str).sort_values(columns).reset_index(drop=True) for d in (wanted, ours)]
    assert sides[0].equals(sides[1])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["query_id", "candidates", "collisions", "first_toi"] and rows.count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
