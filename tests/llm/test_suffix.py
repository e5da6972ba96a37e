import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from codexa.llm.suffix_dedup import binned, dealt, merged, op3_suffix_dedup, remove_repeated, repeated_places, runs
from pyspark.sql import functions as F


def brute(texts, length):
    places = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            places.setdefault(t[p : p + length], []).append((i, p))
    cover = [bytearray(len(t)) for t in texts]
    for found in places.values():
        for i, p in found if len(found) > 1 else ():
            cover[i][p : p + length] = b"\1" * length
    out = []
    for t, c in zip(texts, cover, strict=True):
        spans = sum(1 for j in range(len(c)) if c[j] and (not j or not c[j - 1]))
        out.append((len(t), sum(c), spans, hashlib.sha256(bytes(x for x, y in zip(t, c, strict=True) if not y)).hexdigest()))
    return out


def test_transform_finds_the_repeated_strings():
    draw = np.random.default_rng(3)
    for _ in range(25):
        n = int(draw.integers(60, 2000))
        text = draw.integers(0, 3, n).astype(np.uint8)
        a, b, m = int(draw.integers(0, n // 2)), int(draw.integers(0, n // 2)), min(n // 3, 60)
        text[b : b + m] = text[a : a + m]
        text[-1] = 255
        length = int(draw.integers(8, 50))
        twice = np.concatenate([text, text]).tobytes()
        count = Counter(twice[i : i + length] for i in range(n))
        assert (repeated_places(text, length) == np.array([count[twice[i : i + length]] > 1 for i in range(n)])).all()


def test_runs_cover_every_start_once():
    draw = random.Random(1)
    texts = [bytes(draw.choices(b"ab", k=draw.randrange(0, 500))) for _ in range(30)]
    sizes = np.array([len(t) for t in texts])
    owner, starts, counts, keys, _ = runs(np.frombuffer(b"".join(texts), np.uint8), sizes, 100, 16)
    base = np.cumsum(sizes) - sizes
    seen = sorted((int(o), int(s - base[o]) + i) for o, s, c in zip(owner, starts, counts, strict=True) for i in range(c))
    assert seen == [(o, p) for o, t in enumerate(texts) for p in range(len(t) - 99)]


@pytest.mark.parametrize("more", [{}, {"hot": 500, "batch": 4000}, {"hot": 0}])
def test_removal_equals_brute_force(corpus, rows, more):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeated(corpus, digest=True, **more).collect())
    want = brute([(t or "").encode() for _, t in rows], 200)
    assert got == sorted((str(i), *w) for (i, _), w in zip(rows, want, strict=True))
    assert sum(g[2] > 0 for g in got) > 10


def test_kept_bytes_and_empty_tables(corpus, nothing):
    assert all(len(r.kept) == r.n_bytes - r.n_removed for r in remove_repeated(corpus.limit(5)).collect())
    assert remove_repeated(nothing).count() == 0
    assert merged([(5, 9), (0, 2), (2, 4), (6, 7)]) == [(0, 4), (5, 9)]


def test_bins_cover_every_start_of_a_run_and_hold_their_common_bytes():
    draw = random.Random(2)
    texts = [bytes(draw.choices(b"abcd", k=draw.randrange(100, 500))) for _ in range(20)] + [b"-" * 300]
    sizes = np.array([len(t) for t in texts])
    raw = b"".join(texts)
    for width in (32, 8, 1):
        run, starts, counts, cores = binned(np.frombuffer(raw, np.uint8), sizes, 100, 16, width)
        base = np.cumsum(sizes) - sizes
        assert sorted((int(o), int(s - base[o]) + i) for o, s, c in zip(run, starts, counts, strict=True) for i in range(c)) == [(o, p) for o, t in enumerate(texts) for p in range(len(t) - 99)]
        for s, c, core in zip(starts.tolist(), counts.tolist(), cores.tolist(), strict=True):
            assert s + c - 1 <= core and core + 100 - width + 1 <= s + 100 and c <= width


def test_a_passage_in_thousands_of_documents_is_bounded_work(spark):
    """Keys hold at most `hot` bytes, whatever the number of documents that share a passage; the result is that of brute force."""
    draw = random.Random(4)
    line = lambda n: "".join(draw.choice("abcdefghijklmnop ") for _ in range(n))
    passage, dashes = line(400), "-" * 260
    texts = [line(draw.randrange(20, 120)) + passage + (dashes if i % 9 == 0 else "") + line(draw.randrange(20, 120)) for i in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    _, rows = dealt(docs, hot=20_000)
    size = rows.groupBy("key").agg(F.sum(F.length("run")).alias("size")).agg(F.max("size")).first()[0]
    assert size <= 20_000
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeated(docs, digest=True, hot=20_000).collect())
    assert got == [(i, *w) for i, w in enumerate(brute([t.encode() for t in texts], 200))]


def test_the_query_equals_brute_force_on_a_long_text(spark, corpus, rows, tmp_path):
    draw = random.Random(6)
    long = "".join(draw.choice("abcdefgh \n") for _ in range(300_000))
    long += long[1000:2000] + "x" * 300 + long[:600]
    more = spark.createDataFrame([(900, long, None, None, None, None, None)], corpus.schema)
    corpus.union(more).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op3_suffix_dedup(spark, str(tmp_path)).collect())
    every = [*rows, (900, long)]
    assert got == sorted((str(i), *w) for (i, _), w in zip(every, brute([(t or "").encode() for _, t in every], 200), strict=True))
