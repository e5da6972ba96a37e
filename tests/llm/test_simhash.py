import random

import numpy as np
import xxhash
from codexa.llm.components import components
from codexa.llm.simhash_dedup import _merge, fingerprint, fingerprint_links, keep_one, near_duplicates, trie_forest


def brute_mark(text):
    words = text.lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(marks, budget=3):
    roots = np.arange(len(marks))
    for i in range(len(marks)):
        near = np.flatnonzero(np.bitwise_count(marks[i] ^ marks[i + 1 :]) <= budget) + i + 1
        if len(near):
            roots = _merge(roots, np.full(len(near), i), near)
    return roots


def close_marks(n, seed):
    draw = random.Random(seed)
    marks = [draw.getrandbits(64) for _ in range(n)]
    for _ in range(2 * n):
        m = draw.choice(marks)
        for _ in range(draw.randrange(1, 6)):
            m ^= 1 << draw.randrange(64)
        marks.append(m)
    return np.unique(np.array(marks, np.uint64))


def test_fingerprints_equal_brute_force(rows):
    for _, t in rows:
        assert fingerprint((t or "").encode()) == brute_mark((t or "").encode())


def test_trie_walk_finds_what_all_pairs_find():
    for frontier in (64, 400_000):
        marks = close_marks(150, 4)
        got = trie_forest(np.zeros(len(marks), np.int64), marks, marks, 64, frontier=frontier)
        assert np.array_equal(got, brute_roots(marks))


def test_links_connect_all_components_also_when_keys_are_split(spark):
    marks = close_marks(40, 5)
    rows = spark.createDataFrame([(int(m),) for m in marks.view(np.int64)], "mark long")
    want = brute_roots(marks)
    for key_rows in (50_000, 8):
        links = fingerprint_links(rows, key_rows=key_rows)
        assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 64 for r in links.limit(5).collect())
        named = {r.node: r.root for r in components(links).collect()}
        signed = marks.view(np.int64).tolist()
        label = [named.get(m, m) for m in signed]
        assert len({(a, b) for a, b in zip(label, want.tolist(), strict=True)}) == len(set(label)) == len(set(want.tolist()))


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_get_the_smallest_reachable_id(corpus, rows, nothing):
    got = near_duplicates(corpus).collect()
    marks = np.array([brute_mark((t or "").encode()) for _, t in rows], np.uint64)
    kinds, at = np.unique(marks, return_inverse=True)
    label = brute_roots(kinds)[at]
    least = {k: min((i for (i, _), x in zip(rows, label, strict=True) if x == k and i is not None), default=None) for k in set(label.tolist())}
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted((str(i), str(least[k])) for (i, _), k in zip(rows, label.tolist(), strict=True))
    kept = keep_one(corpus)
    assert kept.columns == corpus.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(least[k]) for k in set(label.tolist()))
    assert near_duplicates(nothing).count() == 0 and keep_one(nothing).count() == 0
