import os

import duckdb
import pytest
from codeloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that find nothing in tables this small.
EMPTY_HERE = {"blast_radius_code", "orphan_docs"}
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def cell(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or str(value) in ("<NA>", "NaT", "nan"):
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows(df):
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    want = duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got) or name in EMPTY_HERE


def test_entry_points():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_clusters_keep_every_vector(spark):
    got = catalog.QUERIES["spectral_clusters"](spark, FOLDER).toPandas()
    assert got.id.is_unique and len(got) == catalog.Tables(spark, FOLDER).embeddings.count()
