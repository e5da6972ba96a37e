import os
from collections import Counter

import numpy as np
from codexa.llm.quality_rules import SYMBOLS, base_failed, fit, judge, measures, op2_quality_rules, posterior, rules


def brute(text):
    words = (text or "").encode().split()
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in SYMBOLS), len(lines) - len(set(lines)), len(inside)


def test_measures_equal_brute_force(corpus, rows):
    got = measures(corpus).collect()
    key = lambda x: (str(x[0]), *x[1:])
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(((i, *brute(t)) for i, t in rows), key=key)


def test_every_row_gets_a_quality(corpus, rows, nothing):
    got = judge(measures(corpus), among=~base_failed()).collect()
    assert len(got) == len(rows) and all(0 <= r.quality <= 1 for r in got)
    assert judge(measures(nothing)).count() == 0
    assert len(rules()) < 12  # the pattern table is broadcast


def test_expectation_maximisation_finds_the_accuracies():
    draw = np.random.default_rng(0)
    good = draw.random(20_000) < 0.8
    votes = np.stack([np.where(draw.random(len(good)) < 0.1, 0, np.where(good, draw.random(len(good)) < 0.97, draw.random(len(good)) < p) * 2 - 1) for p in (0.2, 0.3, 0.3, 0.4, 0.5)], axis=1)
    share, on_good, on_bad = fit(sorted(Counter(map(tuple, votes.tolist())).items()))
    assert abs(share - 0.8) < 0.05 and (on_good[:, 1] > 0.93).all() and (on_bad[:, 1] < 0.65).all()
    assert ((posterior(votes, share, on_good, on_bad) >= 0.5) == good).mean() > 0.95


def test_the_verdict_is_no_fixed_threshold(corpus):
    """The same votes are good in one corpus and bad in another: the rules' accuracies are learned, not their number."""
    split = (1, 1, -1, 1, 1)  # one rule against
    sharp = [((1, 1, 1, 1, 1), 900), ((-1, -1, -1, -1, -1), 60), ((0, 0, -1, 0, -1), 60), (split, 40)]
    noisy = [((1, 1, 1, 1, 1), 500), (split, 450), ((-1, -1, 1, -1, -1), 60), ((-1, -1, -1, -1, -1), 60)]
    chance = [posterior(np.array([split]), *fit(p))[0] for p in (sharp, noisy)]
    on_bad = [fit(p)[2][2, 0] for p in (sharp, noisy)]
    assert chance[1] > chance[0] and on_bad[0] > on_bad[1]
    turned = (-1, -1, 1, 1, 1)
    agree = [((1, 1, 1, 1, 1), 900), ((-1, -1, -1, -1, -1), 90), ((1, 1, -1, -1, -1), 30)]
    loose = [((1, 1, 1, 1, 1), 300), ((1, 1, -1, -1, -1), 600), ((1, 1, 1, -1, -1), 200), ((1, 1, -1, 1, -1), 200), (turned, 40), ((-1, -1, -1, -1, -1), 60)]
    assert [bool(posterior(np.array([turned]), *fit(p))[0] >= 0.5) for p in (agree, loose)] == [False, True]


def test_the_query_holds_base_figures_and_learns_the_labels(spark, corpus, rows, tmp_path):
    corpus.write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in op2_quality_rules(spark, str(tmp_path)).collect():
        got.setdefault((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), []).append(r)
    want = Counter(brute(t) for _, t in rows)
    assert {k: len(v) for k, v in got.items()} == want
    for (n, *_, repeated), found in got.items():
        assert all(r.base_failed == (n < 20 or 100 * repeated > 30 * n) and (not r.base_failed or not r.kept) and r.kept == (not r.base_failed and r.quality >= 0.5) for r in found)
    sf = "/root/testdata/sf0.01"
    if os.path.isdir(sf):
        kept = {r.doc_id: r.kept for r in op2_quality_rules(spark, sf).where("NOT base_failed").collect()}
        good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
        right = [kept[i] == bool(good[i]) for i in kept if i in good]
        assert len(right) > 100 and sum(right) / len(right) > 0.97
