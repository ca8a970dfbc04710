"""Every query with SQL against DuckDB on the driver's tables."""

import glob

import duckdb
import pytest

from quern.plans import catalogue, catalogue_io  # noqa: F401  (the second adds its queries to the first's)

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(f"{x:.6f}" if isinstance(x, float) else repr(x) for x in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_is_its_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_written_graph_reads_back(spark):
    built, back = (catalogue.QUERIES[q](spark, FOLDER) for q in ("kg_triples", "turtle_roundtrip"))
    assert built.exceptAll(back).isEmpty() and back.exceptAll(built).isEmpty()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
