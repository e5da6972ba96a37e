import os

import pytest

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
if not os.path.isdir(FOLDER):
    pytest.skip("no tables here", allow_module_level=True)

from codexa.plans.registry import ALL  # noqa: E402


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in ALL.items() if sql))
def test_query_equals_its_sql(spark, tables, name):
    query, sql = ALL[name]
    got, want = query(spark, FOLDER), tables.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(map(str, got.select(*sorted(got.columns)).toPandas().astype(object).where(lambda d: d.notna(), None).itertuples(index=False, name=None)))
    pick = ", ".join(f'"{c}"' for c in sorted(want.columns))
    assert rows == sorted(map(str, tables.sql(f"SELECT {pick} FROM ({sql})").df().astype(object).where(lambda d: d.notna(), None).itertuples(index=False, name=None)))


def test_page_text_equals_its_sql_where_a_title_is_cut_in_a_reference(spark, tmp_path):
    pages = [(i, f"<!DOCTYPE html><html><head><title>x</title></head><body><h1>a &amp;&amp; b{cut}</h1><p>c &copy;</p></body></html>") for i, cut in enumerate(("&amp", "&am", "&amp;", "&quot", "&"))]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    query, sql = ALL["page_text"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert sorted(map(tuple, query(spark, str(tmp_path)).collect())) == sorted(con.sql(sql).fetchall())


def test_entry_finds_the_flagship(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() == 200


def test_isbn_find_covers_every_key(spark):
    from codexa.plans.rules import isbn_find
    from codexa.plans.text import isbn_check_digits

    got = {r.key: r.isbns for r in isbn_find(spark, FOLDER).collect()}
    want = {r.key: r.isbn13 for r in isbn_check_digits(spark, FOLDER).collect()}  # the ISBN-10 names the same book
    assert got.keys() == want.keys() and {k for k in got if got[k] != want[k]} <= {0}  # all zeros are a placeholder
