"""Every query of this subpackage over a small table with nulls, repeated rows and clashing columns, over no rows, and against its SQL."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codexa.llm.registry import oracle_sql, queries

PAGES = "page_id long, url string, html string, text string"
RETURNED = {
    "op1": "doc_id size source_size target taken", "op2": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op3": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op4": "doc_id held_out lang_pred score", "op5": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op6": "doc_id fingerprint component_id",
    "op7": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", "op8": "doc_id n_lines n_removed kept_sha256", "op9": "page_id url text n_chars",
    "op10": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.fixture(scope="module")
def stored(spark, corpus, tmp_path_factory):
    folder = tmp_path_factory.mktemp("registered")
    corpus.withColumns({"title": F.lit("t"), "text_key": F.lit(1), "mark": F.lit("m"), "key": F.lit(2), "n": F.lit(3)}).write.parquet(f"{folder}/documents.parquet")
    pages = [(1, "u", "<article><p>text " + "word " * 30 + "</article>", "x"), (2, None, None, None), (2, None, None, None), (None, "u", "", "")]
    spark.createDataFrame(pages, PAGES).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def hollow(spark, nothing, tmp_path_factory):
    folder = tmp_path_factory.mktemp("hollow")
    nothing.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], PAGES).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries()))
def test_a_row_for_each_row_with_the_columns_asked_for(spark, stored, hollow, name):
    query, wanted = queries()[name], RETURNED[name.split("_")[0]].split()
    out = query(spark, stored)
    assert out.columns[: len(wanted)] == wanted
    key = wanted[0]
    table = spark.read.parquet(f"{stored}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    ids = sorted(str(r[0]) for r in table.select(key).collect())
    assert sorted(str(r[0]) for r in out.select(key).collect()) == ids
    none = query(spark, hollow)
    assert none.collect() == [] and none.columns == out.columns


def test_the_pipeline_over_no_rows(spark, hollow):
    assert corpus_pipeline.run(spark, hollow).collect() == []


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    out = queries()[name](spark, sf)
    names = ", ".join(out.columns)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, con.sql(f"SELECT {names} FROM ({oracle_sql()[name]})").fetchall()))


@pytest.fixture(scope="module")
def megabyte(spark, tmp_path_factory):
    """A text of a megabyte, twice, beside a null one and short ones of two languages."""
    folder = tmp_path_factory.mktemp("megabyte")
    long = "\n".join(f"the water of house {i} and light {i * 7919 % 10007}" for i in range(26_000))
    rows = [(1, long, "en", "a", 0), (1, long, "en", "a", 0), (2, None, None, None, None)] + [(10 + i, ("the water and light " if i % 2 else "der die und nicht ") * 9, ("de", "en")[i % 2], "b", 0) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    page = f"<nav><a>x</a></nav><article>{''.join(f'<p>{line}</p>' for line in long.split(chr(10)))}</article>"
    spark.createDataFrame([(1, "u", page, ""), (1, "u", page, "")], PAGES).write.parquet(f"{folder}/pages.parquet")
    return str(folder), long


@pytest.mark.parametrize("name", sorted(queries()))
def test_a_text_of_a_megabyte_is_read_whole_and_equal_rows_have_equal_values(spark, megabyte, name):
    folder, long = megabyte
    words = long.split()
    key = RETURNED[name.split("_")[0]].split()[0]
    found = [r for r in queries()[name](spark, folder).collect() if r[key] == 1]
    assert len(long) > 1_000_000 and len(found) == 2 and (name.startswith("op1_") or found[0] == found[1] or name.startswith("op8_"))
    whole = {
        "op1": lambda r: r.size == len(words), "op2": lambda r: r.n_words == len(words) and r.word_chars == sum(map(len, words)), "op3": lambda r: r.n_removed == r.n_bytes == len(long),
        "op4": lambda r: r.lang_pred == "en" and r.score > 0.5, "op5": lambda r: r.n_email == 0, "op6": lambda r: r.component_id == 1 and len(r.fingerprint) == 16, "op7": lambda r: r.n_bytes == len(long),
        "op8": lambda r: r.n_lines == 26_000, "op9": lambda r: r.text == " ".join(words), "op10": lambda r: r.n_tokens > len(words) and r.decoded_sha256 == hashlib.sha256(long.encode()).hexdigest(),
    }
    assert all(whole[name.split("_")[0]](r) for r in found)
