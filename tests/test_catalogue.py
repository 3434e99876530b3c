import duckdb
import pytest

from gridweave.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    cols = sorted(df.columns)
    clean = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) or hasattr(v, "dtype") else v
    return cols, sorted((tuple(clean(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    if name not in catalogue.ORACLE_SQL:
        assert got.count() > 0
        return
    assert rows(got.toPandas()) == rows(con.execute(catalogue.ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["i", "j", "v"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
