import random
from collections import defaultdict

import pytest
from codexa.llm.mixing import CHUNK, OP1_SQL, PRODUCTION, mix, mixed, op1_mix_sources, targets


def test_targets_share_the_excess():
    got = targets({"a": 100, "b": 1000, "c": 10, None: 50}, [3, 1, 2], 1.5, 2)
    assert got["a"] == 200 and got["c"] == 20 and got[None] == 100
    assert sum(got.values()) == pytest.approx(1.5 * 1160)
    assert targets({}, [1], 1.5, 2) == {} and targets({"a": 0}, [1], 1.5, 2) == {"a": 0.0}


def test_mix_is_near_its_targets_and_reruns_agree(corpus, rows):
    runs = [mix(c, **PRODUCTION).select("doc.doc_id", "doc.source", "doc.text", "size", "source_size", "target", "copies").collect() for c in (corpus, corpus.repartition(7))]
    first, again = (sorted(map(str, r)) for r in runs)
    assert first == again and len(first) == len(rows)
    taken, want, largest = defaultdict(int), {}, defaultdict(int)
    for r in runs[0]:
        assert r.size == len((r.text or "").encode().split()) and r.copies <= 2
        taken[r.source] += r.copies * r.size
        want[r.source], largest[r.source] = r.target, max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] + 1 for s in want)


def test_chunks_do_not_change_the_counts(corpus):
    total = lambda chunk: {r.source: r.n for r in mix(corpus, chunk=chunk, **PRODUCTION).groupBy("doc.source").agg({"copies": "sum"}).withColumnRenamed("sum(copies)", "n").collect()}
    assert total(5) == total(1000)


def test_mixed_keeps_the_columns(corpus, nothing):
    assert mixed(corpus, **PRODUCTION).columns == corpus.columns
    assert mixed(nothing, **PRODUCTION).count() == 0


def test_the_query_equals_its_sql_beyond_one_chunk(spark, tmp_path):
    """Sources of several chunks, of one, of no words, a null one; null and repeated ids and texts."""
    duckdb = pytest.importorskip("duckdb")
    draw = random.Random(8)
    rows = [(i, " ".join("w" * draw.randrange(1, 4) for _ in range(draw.randrange(0, 30))), draw.choice(["a", "a", "a", "b", None])) for i in range(3 * CHUNK)]
    rows += [(None, "x y", "a"), (None, None, "a"), (5, rows[5][1], rows[5][2]), (7, None, "b"), (8, "", "none"), (9, "one", "few")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    names = "doc_id, size, source_size, target, taken"
    want = con.sql(f"SELECT {names} FROM ({OP1_SQL})").fetchall()
    got = [tuple(r) for r in op1_mix_sources(spark, str(tmp_path)).select(*names.split(", ")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == len(rows)
    taken, target, largest = defaultdict(int), {}, max(r[1] for r in got)
    for r in got:
        taken[r[2:4]] += r[4]
        assert r[4] <= 2 * r[1]
    assert len(taken) == 5 and all(abs(t - n) <= max(2 * largest, 0.005 * t) for (_, t), n in taken.items())
