"""Printed volumes of works with more chapters than there are numerals, against their SQL."""

import duckdb
import pytest
from test_catalog import rows

from lexmill.plans import catalog

CHAPTERS = (1, 2, 3, 60, 61, 62, 603, 0, -1, -61)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("printed")
    text = "'Thus ends the ' || ['first', 'second', 'third', 'fourth'][1 + greatest(c, 0) % 4] || ' chapter' || chr(10) || 'rice ' || c || 'x' || i || chr(10) || '[ Chap. II' || chr(10) || 'milk'"
    duckdb.sql(
        f"copy (select s || '-ch' || c || '-' || i as chunk_id, s as source, c::int as chapter, i::int as chunk_index, {text} as text, null::varchar[] as herbs, null::varchar[] as diseases, null::varchar[] as doshas_mentioned, 1::int as n_tokens, null::varchar as section_role "
        f"from (select unnest(['one-vol1', 'two-vol1-adisthana', 'two-vol1-antasthana']) as s), (select unnest({list(CHAPTERS)}) as c), range(3) t(i)) to '{path}/all_chunks.parquet' (format parquet)"
    )
    return str(path)


def equal(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view all_chunks as select * from '{folder}/all_chunks.parquet'")
    got, want = catalog.QUERIES[name](spark, folder).toPandas(), con.execute(catalog.SQL[name]).df()
    assert len(want) > 0 and sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_chapter_bounds(spark, folder):
    equal(spark, folder, "chapter_bounds")


def test_section_chapters(spark, folder):
    equal(spark, folder, "section_chapters")


def test_chapter_words(spark, folder):
    equal(spark, folder, "chapter_words")


def test_printed_volumes(spark, folder):
    equal(spark, folder, "printed_volumes")


def test_first_warnings(spark, folder):
    equal(spark, folder, "first_warnings")


def test_rechunked_volumes_keep_every_record(spark, folder):
    got = " ".join(r["text"] for r in catalog.QUERIES["rechunked_volumes"](spark, folder).collect()).split()
    for chapter in (60, 61, 62, 603):
        for i in range(3):
            assert got.count(f"{chapter}x{i}") == 3


def test_section_bounds(spark, folder):
    equal(spark, folder, "section_bounds")


def test_rechunked_volumes_read_their_lines_few_times(spark, folder):
    plan = catalog.QUERIES["rechunked_volumes"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 20
