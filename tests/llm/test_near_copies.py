import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from codexa.llm.near_copies import _joined, labelled, shingle_sets, similar
from codexa.llm.simhash_dedup import shingle_hashes


@pytest.mark.parametrize("shingles", [2_000_000, 400])
def test_planted_copies_of_similarity_08_go(spark, shingles):
    """Each original has copies with a few words changed; brute force over all pairs gives the components."""
    draw = random.Random(3)
    rows = []
    for group in range(40):
        words = [f"w{draw.randrange(10**6)}" for _ in range(draw.choice([50, 100, 400]))]
        for changes in (0, 1, 1, 2, 3):
            copy = list(words)
            for _ in range(changes * len(words) // 100 + (changes > 0)):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    words = [f"d{i}" for i in range(300)]  # a chain: neighbours are near, its ends are not
    for i in range(12):
        rows.append((len(rows), " ".join([f"c{i}_{j}" if j < 20 * i else w for j, w in enumerate(words)] if i < 1 else [f"e{j}" if j < 12 * i else w for j, w in enumerate(words)])))
    rows += [(900, ""), (901, None), (902, "one"), (903, "one"), (None, rows[0][1])]
    sets = [np.unique(shingle_hashes((t or "").encode(), 5)) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])]
    for i, j in pairs:
        root[max(top(i), top(j))] = min(top(i), top(j))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {}
    for r in labelled(docs, shingles=shingles).collect():
        got.setdefault(r.root, []).append(r.doc_id)
    want = {}
    for i, (doc, _) in enumerate(rows):
        want.setdefault(top(i), []).append(doc)
    assert len(pairs) > 100 and sorted(sorted(map(str, x)) for x in got.values()) == sorted(sorted(map(str, x)) for x in want.values())
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(kept) == sorted(min(d for d in x if d is not None) for x in want.values())


def test_no_rows(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert labelled(nothing).count() == 0 and corpus_pipeline.near_duplicates(spark, nothing, "").count() == 0


def test_only_links_that_join_labels_leave_a_bucket():
    draw = np.random.default_rng(0)
    base = draw.choice(2**62, 100, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate([np.delete(base, draw.choice(100, 8, replace=False)), draw.choice(2**62, 3).astype(np.uint64)])) for _ in range(60)]
    a, b = _joined(np.arange(60), np.arange(60), sets)
    root = list(range(60))
    for i in range(60):
        for j in range(60):
            if similar(sets[i], sets[j]):
                x, y = root[i], root[j]
                root = [y if r == x else r for r in root]
    assert len(a) == 60 - len(set(root)) and all(similar(sets[i], sets[j]) for i, j in zip(a, b, strict=True))


def test_shingle_sets_tell_apart_what_strings_do():
    draw = random.Random(5)
    texts = [" ".join(draw.choice("ab") for _ in range(draw.randrange(0, 12))) + draw.choice(["", " ", "\n", "\u00a0x"]) for _ in range(400)] + [None, "", " A b\tC  d e ", "a b c d e"]
    codes, sizes = shingle_sets(pa.array(texts), 5)
    ends = np.cumsum(sizes)
    seen = {}
    for t, size, end in zip(texts, sizes, ends, strict=True):
        words = (t or "").encode().lower().split()
        plain = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        own = codes[end - size : end]
        assert size == len(plain) and (np.diff(own.astype(object)) > 0).all()
        assert seen.setdefault(frozenset(plain), own.tolist()) == own.tolist()
    assert len({tuple(v) for v in seen.values()}) == len(seen)
