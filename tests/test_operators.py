from collections import Counter

import pytest
from codexa.operators import dedup
from codexa.operators import resources as rs
from codexa.operators import scan as sc
from pyspark.sql import functions as F

RESOURCES = [("b", 0, "a", "x/../1.htm"), ("b", 1, "b", "1.htm#f"), ("b", 2, "a", "2.htm"), ("b", 3, "c", ""), ("b", 4, "d", ""), ("b", 5, "e", "2.htm"), ("c", 0, "z", "1.htm")]


@pytest.fixture(scope="module")
def resources(spark):
    return spark.createDataFrame(RESOURCES, "book_id string, pos int, id string, href string")


def test_first_of_an_href_stays(resources):
    assert sorted((r.book_id, r.pos) for r in rs.unique_resources(resources).collect()) == [("b", 0), ("b", 2), ("b", 3), ("b", 4), ("c", 0)]
    assert sorted(tuple(r) for r in rs.aliases(resources).collect()) == [("b", "b", 0), ("b", "e", 2)]
    order = resources.select("book_id", "pos", F.col("pos").alias("resource_pos"), F.lit(True).alias("linear"))
    assert sorted((r.book_id, r.pos, r.resource_pos) for r in rs.canonical_order(order, resources).collect()) == [("b", 0, 0), ("b", 1, 0), ("b", 2, 2), ("b", 3, 3), ("b", 4, 4), ("b", 5, 2), ("c", 0, 0)]


def test_lookups(spark, resources):
    wanted = spark.createDataFrame([("b", "./1.htm?q"), ("b", "none"), ("c", "1.htm")], "book_id string, href string")
    assert sorted((r.book_id, r.id) for r in rs.by_href(resources, wanted).collect()) == [("b", "a"), ("c", "z")]
    assert rs.by_id(resources, spark.createDataFrame([("b", "d")], "book_id string, id string")).count() == 1
    got = spark.createDataFrame([("text/html", ""), ("image/png", None), ("text/css", "CP1251")], "m string, c string").select(rs.charset_column(F.col("m"), F.col("c")).alias("x"))
    assert [r.x for r in got.collect()] == ["utf-8", "binary", "cp1251"]


PARTS = [(1, 0, True, True, "one"), (1, 2, True, True, ""), (1, 1, False, True, "note ISBN 0306406152"), (1, 9, False, False, "extra 043942089X 9780306406157"), (2, 0, False, True, "only a note"), (3, 1, True, True, "b ISBN 0306406152"), (3, 0, True, True, None)]


@pytest.fixture(scope="module")
def parts(spark):
    return spark.createDataFrame(PARTS, "book_id int, pos int, linear boolean, in_order boolean, text string")


def test_reading_text(parts):
    assert {r.book_id: r.text for r in rs.reading_text(parts, "\n").collect()} == {1: "one\n", 2: "", 3: "\nb ISBN 0306406152"}
    assert {r.book_id: r.text for r in rs.reading_text(parts).collect()} == {1: "one", 2: "", 3: "b ISBN 0306406152"}


def test_scan(parts):
    rows = {r.book_id: r for r in sc.scan_reading_order(parts, sc.text_head(3), None, sc.isbns(limit=1), sc.fingerprints(n=4)).collect()}
    assert rows[1].head == "one" and rows[3].isbns == ["0306406152"] and rows[2].fingerprint.simhash == 0
    with pytest.raises(TypeError):
        sc.Processor("", lambda t: t)
    with pytest.raises(ValueError):
        sc.scan(parts, sc.text_head(1), sc.text_head(2))


def test_heads_cut_at_bytes(spark):
    rows = spark.createDataFrame([(1, "aé\U0001f600b")], "book_id int, text string")
    assert [sc.scan(rows, sc.text_head(n)).first().head for n in (0, 1, 2, 3, 6, 7, 8, 99)] == ["", "a", "a", "aé", "aé", "aé\U0001f600", "aé\U0001f600b", "aé\U0001f600b"]


def test_heads_of_few_parts_equal_heads_of_whole_texts(spark):
    rows = [(1, 0, True, True, "abc"), (1, 1, True, True, "d"), (2, 0, True, True, "é"), (2, 1, False, True, "note"), (2, 2, True, True, None), (2, 3, True, True, "x"), (3, 0, False, True, "only a note"), (4, 5, True, True, "b"), (4, 5, True, True, "a")]
    parts = spark.createDataFrame(rows, "book_id int, pos int, linear boolean, in_order boolean, text string")
    for n in range(1, 8):
        few = sc.scan(rs.reading_text(sc.heads_only(parts, n), "\n"), sc.text_head(n))
        assert sorted(few.collect()) == sorted(sc.scan_reading_order(parts, sc.text_head(n)).collect())


def test_book_isbns_go_on_to_other_parts(parts):
    assert {r.book_id: r.isbns for r in sc.book_isbns(parts).collect()} == {1: ["0306406152", "043942089X"], 2: [], 3: ["0306406152"]}
    assert {r.book_id: r.isbns for r in sc.book_isbns(parts, limit=1).collect()} == {1: ["0306406152"], 2: [], 3: ["0306406152"]}


def test_simhash_pairs_equal_all_pairs(spark):
    import random

    draw = random.Random(2)
    marks = [draw.getrandbits(64) for _ in range(60)]
    marks += [m ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(1, 5))) for m in marks]
    rows = [(i, m - 2**64 if m >= 2**63 else m) for i, m in enumerate(marks)] + [(999, marks[0] - 2**64 if marks[0] >= 2**63 else marks[0])]
    got = Counter(tuple(r) for r in dedup.simhash_pairs(spark.createDataFrame(rows, "doc_id long, simhash long")).collect())
    want = {(i, j, d) for i in range(len(marks)) for j in range(i + 1, len(marks)) if 0 < (d := (marks[i] ^ marks[j]).bit_count()) <= 3}
    assert set(got) == want and set(got.values()) <= {1} and len(want) > 20
    with pytest.raises(ValueError):
        dedup.simhash_pairs(None, 4)


def test_minhash_pairs_and_groups(spark):
    rows = spark.createDataFrame([(1, list(range(128))), (2, [*range(120), *([-1] * 8)]), (3, [7] * 128), (4, [7] * 128)], "doc_id long, minhash array<long>")
    assert [tuple(r) for r in dedup.minhash_pairs(rows).collect()] == [(1, 2, 120 / 128)]
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "doc_id int, text string")
    assert [(r.n, r.first) for r in dedup.exact_groups(docs).collect()] == [(2, 1)]


def test_every_query_is_registered():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 35


def test_minhash_pairs_meet_wherever_they_differ(spark):
    one = list(range(128))
    rows = [(0, one)]
    for i, places in enumerate(([*range(0, 125, 5)], [*range(4, 128, 5)], [*range(3, 128, 8), *range(0, 72, 8)], [*range(0, 26)])):
        rows.append((i + 1, [-1000 * (i + 1) - x if x in places else x for x in one]))
    got = {tuple(r)[:2]: r.jaccard for r in dedup.minhash_pairs(spark.createDataFrame(rows, "doc_id long, minhash array<long>")).collect()}
    want = {(i, j): s / 128 for i, x in rows for j, y in rows if i < j and (s := sum(a == b for a, b in zip(x, y, strict=True))) >= 0.8 * 128}
    assert got == want and len(want) >= 3


def test_simhash_members_keep_documents_without_a_fingerprint(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 5), (4, None), (5, 0)], "doc_id long, simhash long")
    assert sorted(map(tuple, dedup.simhash_members(rows).collect())) == [(1, 1, 2), (2, 2, 2), (3, 1, 2), (4, 2, 2), (5, 5, 1)]


def test_minhash_pairs_equal_brute_force_over_documents(spark):
    """Every pair of the smallest table whose signatures agree in 0.8 of their places is found."""
    import os

    import numpy as np
    from codexa.functions import fingerprint

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", fingerprint.minhash(F.col("text")).alias("minhash"))
    held = {}
    for r in sorted(rows.collect(), key=lambda r: r.doc_id):
        held.setdefault(tuple(r.minhash), r.doc_id)
    marks, ids = np.array(list(held)), list(held.values())
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in range(i + 1, len(ids)) if (marks[i] == marks[j]).mean() >= 0.8}
    assert {(r.a, r.b) for r in dedup.minhash_pairs(rows).collect()} == want


def test_simhash_pairs_are_joined_where_the_rows_are(spark):
    """Twenty keys a row escape the planner's estimate: the pairs' join never gathers a side on the driver."""
    rows = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 8 + F.floor(F.col("id") / 8) * 2**40).alias("simhash"))
    pairs = dedup.simhash_pairs(rows)
    marks = [i % 8 + (i // 8 << 40) for i in range(40)]
    want = {(i, j, d) for i in range(40) for j in range(i + 1, 40) if (d := (marks[i] ^ marks[j]).bit_count()) <= 3}
    assert {tuple(r) for r in pairs.collect()} == want
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
