"""The queries of the catalog that search for every manifest, with more manifests than go to every task, against their SQL."""

import duckdb
import pytest
from test_catalog import FOLDER, rows

from lexmill.operators import retrieval
from lexmill.plans import catalog


def equal(spark, monkeypatch, name):
    monkeypatch.setattr(retrieval, "QUERIES", 4)
    con = duckdb.connect()
    for t in ("all_chunks", "manifests"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    found, want = catalog.QUERIES[name](spark, FOLDER), con.execute(catalog.SQL[name]).df()
    assert "CoGroups" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert len(want) > 4 and rows(found.toPandas()) == rows(want)


def test_retrieval_checks(spark, monkeypatch):
    equal(spark, monkeypatch, "retrieval_checks")


def test_retrieval_eval(spark, monkeypatch):
    equal(spark, monkeypatch, "retrieval_eval")


@pytest.mark.parametrize("most", [0, 200_000])
def test_rows_once(spark, monkeypatch, most):
    from lexmill.operators import records

    monkeypatch.setattr(records, "REPEATED", most)
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "x"), (None, "z"), (None, "z"), ("c", None)], "id string, text string").repartition(3)
    assert sorted(map(repr, map(tuple, records.once(rows, "id").collect()))) == sorted(map(repr, [("a", "x"), ("b", "y"), (None, "z"), ("c", None)]))
    one = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    assert sorted(map(tuple, records.once(one, "id").collect())) == [("a", "x"), ("b", "y")]


def test_search_moves_repeated_texts_only(spark, tmp_path, monkeypatch):
    from lexmill.operators import retrieval
    from lexmill.plans import catalog

    spark.range(100).selectExpr("'c' || id % 99 as chunk_id", "'rice ' || id % 99 as text").write.parquet(f"{tmp_path}/all_chunks.parquet")
    spark.range(3).selectExpr("'m' || id as artifact_dir", "'rice ' || id as query").write.parquet(f"{tmp_path}/manifests.parquet")
    held = []
    monkeypatch.setattr(retrieval, "bm25", lambda corpus, *a: held.append(corpus) or corpus)
    catalog.QUERIES["manifest_search"](spark, str(tmp_path))
    plan = held[0]._jdf.queryExecution().optimizedPlan().toString()
    assert held[0].count() == 99 and "LeftAnti" in plan and "LeftSemi" in plan
