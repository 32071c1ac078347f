"""Queries with SQL against it, and the pipeline's stages against plain versions of their decisions."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from sealbook.llm.oracles import oracles
from sealbook.llm.queries import queries

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(oracles()))
def test_same_rows(spark, duck, name):
    df = queries()[name](spark, str(FOLDER))
    sql = duck.sql(oracles()[name])
    assert sorted(sql.columns) == sorted(df.columns)
    assert Counter(map(tuple, df.collect())) == Counter(sql.select(*df.columns).fetchall())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracles())))
def test_all_rows(spark, duck, name):
    of = "pages" if name.startswith("op2_") else "documents"
    assert queries()[name](spark, str(FOLDER)).count() == duck.sql(f"select count(*) from {of}").fetchall()[0][0]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(str(FOLDER / "documents.parquet"))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(FOLDER)).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        assert 0 < docs.count() <= before.count()
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    kept = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert {r.doc_id: r.text for r in docs.collect()} == kept
    whole = {r.doc_id: r.text for r in corpus_pipeline.run(spark, str(FOLDER)).collect()}
    assert whole == kept
