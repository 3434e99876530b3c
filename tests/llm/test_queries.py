import duckdb
import pytest

import corpus_pipeline
from gridweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    clean = lambda df: sorted((tuple(None if v is None or v != v else int(v) if hasattr(v, "dtype") or isinstance(v, float) else v for v in r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)), key=repr)
    assert clean(got) == clean(want)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_gives_a_row_for_each_input(spark, name):
    table = "pages" if name.startswith(("op2", "op5", "op7")) else "documents"
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    got = queries.QUERIES[name](spark, SF).count()
    assert got == n or name.startswith("op1_") and got > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        new = stage(spark, docs, SF)
        assert k == len(corpus_pipeline.STAGES) - 1 or new.columns == columns
        assert 0 < new.count() <= docs.count() or k == len(corpus_pipeline.STAGES) - 1
        docs = new
    # stage by stage, brute force: rejected, duplicate and contaminated texts are gone
    from gridweave.llm import decontaminate, secrets, simhash

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert decontaminate.matches(out, bench).where("leak.n_hit >= 10").count() == 0
    assert secrets.scan(out).where("size(assign) + size(access) + size(hex) + size(markov) > 0").count() == 0
    whole = out.where("taken = tokens and epoch = 0").select("doc_id", "text")
    assert whole.count() > 0 and simhash.near_duplicates(whole).select("component_id").distinct().count() >= 0.95 * whole.count()


def test_pipeline_odd_cases(spark, tmp_path):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, clashing
    names, and empty tables, through all stages."""
    from pyspark.sql import functions as F

    sf = str(tmp_path)
    real = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    long = "A sentence of quiet words that goes on, one after the other, for as long as it has to. " * 4000
    odd = [(None, None, None, None, None), (None, "", "en", "a", 0), (-1, " \n\t ", "xx", "", 3), (-2, long, "en", "a", len(long)), (-2, long, "en", "a", len(long)), (-3, "one", "en", None, 3), (-3, "two", "en", None, 3)]
    clash = {c: F.lit("own") for c in ("id", "_id", "t", "fp", "leak", "row", "new", "score", "full", "h", "n")}
    docs = real.unionByName(spark.createDataFrame(odd, real.schema)).withColumns(clash)
    docs.write.parquet(f"{sf}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{sf}/{name}.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf).write.parquet(f"{sf}/out{k}")
        new = spark.read.parquet(f"{sf}/out{k}")
        assert new.columns[: len(docs.columns)] == docs.columns
        assert new.where(" or ".join(f"{c} <> 'own'" for c in clash)).count() == 0
        assert new.groupBy("doc_id", "text").count().where("count > 1").count() == 0 or k in (0, 4)
        now = new
    assert now.count() > 0 and now.where("n_chars <> length(text)").count() == 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
