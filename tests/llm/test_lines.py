from codexa.llm.line_dedup import drop_repeated, lines_of, merged, without_repeated


def brute(rows):
    """Rows of equal id and text are one document."""
    docs = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    seen, gone = set(), {}
    for d in docs:
        lines, full = lines_of(d[2].encode())
        drop = set()
        for p in range(len(full) - 2):
            key = tuple(lines[i] for i in full[p : p + 3])
            if key in seen:
                drop |= set(full[p : p + 3])
            seen.add(key)
        gone[d] = (len(full), len(drop), b"\n".join(x for i, x in enumerate(lines) if i not in drop).decode())
    return [gone[i is not None, i or 0, t or ""] for i, t in rows]


def test_equals_brute_force(corpus, rows, nothing):
    got = drop_repeated(corpus).select("doc.doc_id", "n_lines", "n_removed", "kept").collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_removed, r.kept or "") for r in got) == sorted((str(i), *w) for (i, _), w in zip(rows, brute(rows), strict=True))
    assert sum(r.n_removed > 0 for r in got) > 5 and [r.kept for r in got if r.doc_id == 62] == [None]
    assert drop_repeated(nothing).count() == 0


def test_columns_stay_and_emptied_documents_go(corpus, rows):
    kept = without_repeated(corpus)
    assert kept.schema.simpleString() == corpus.schema.simpleString()
    got = kept.collect()
    want = [(i, w) for (i, _), w in zip(rows, brute(rows), strict=True) if not w[1] or w[1] < w[0]]
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in want)
    assert all(r.n_chars == len(r.text or "") for r in got)
    assert merged([4, 0, 1], 3) == [0, 1, 2, 3, 4, 5, 6]
