import itertools
import random

import numpy as np
from codexa.llm import language_id
from codexa.llm.language_id import SAMPLE, accepted, fit, held_out, marginals, predict, train
from pyspark.sql import functions as F


def test_forward_backward_equals_enumeration():
    draw = np.random.default_rng(0)
    scores, moves, lengths = draw.normal(size=(17, 3)), draw.normal(size=(3, 3)), np.array([5, 4, 8])
    got, at = marginals(scores, lengths, moves, step=3), 0
    for n in lengths.tolist():
        total = np.zeros((n, 3))
        for y in itertools.product(range(3), repeat=n):
            weight = np.exp(np.log(np.exp(moves[:, y[0]]).sum()) + scores[at, y[0]] + sum(moves[y[i - 1], y[i]] + scores[at + i, y[i]] for i in range(1, n)))
            for i in range(n):
                total[i, y[i]] += weight
        assert np.allclose(got[at : at + n], total / total.sum(axis=1, keepdims=True))
        at += n


def test_held_out_documents_are_recognised(corpus, rows):
    got = predict(corpus, train(corpus)).collect()
    gold = {r.doc_id: r.lang for r in corpus.where(held_out()).collect() if r.text and any(map(str.isalpha, r.text)) and len(r.text) > 20}
    assert len(got) == len(rows) and len(gold) > 8
    right = [r.lang_pred == gold[r.doc_id] for r in got if r.doc_id in gold]
    assert sum(right) >= 0.9 * len(right)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {62, 63, 64, 65} <= und and all(0 <= r.score <= 1 and (r.score == 0) == (r.lang_pred == "und") for r in got)


def test_words_of_a_switch_are_labelled(spark, corpus):
    model = fit({"en": [r.text for r in corpus.where("lang = 'en' AND length(text) > 300").collect()], "de": [r.text for r in corpus.where("lang = 'de' AND length(text) > 300").collect()]})
    row = predict(spark.createDataFrame([(1, "the water and light of that house durch eine straße können die häuser")], "doc_id int, text string"), model, words=True).first()
    assert row.word_langs[:4] == ["en"] * 4 and row.word_langs[-4:] == ["de"] * 4


def test_rejected_ones_go_and_nothing_learned_gives_und(corpus, nothing):
    kept = accepted(corpus)
    assert kept.columns == corpus.columns and {r.doc_id for r in kept.collect()} & {62, 63, 64, 65} == set()
    assert accepted(nothing).count() == 0
    model = train(corpus.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r.lang_pred for r in predict(corpus, model).collect()} == {"und"}


def test_sample_covers_long_documents_and_repeated_ids(spark):
    draw = random.Random(1)
    pools = {"en": "the of and that with water light".split(), "de": "der die und nicht straße häuser größer".split(), "fr": "le la les des une être maison".split()}
    text = {k: lambda n, k=k: " ".join(draw.choice(pools[k]) for _ in range(n)) for k in pools}
    rows = [(None, text["en"](30), "en") for _ in range(4_000)]  # one id for all, and far over the limit
    rows += [(i, text["de"](6_000), "de") for i in range(40)]  # all longer than a passage
    rows += [(5_000 + i, text["fr"](6_000 if i % 100 else 30), "fr") for i in range(200)]
    rows += [(7, "und nicht", "de")] * 3_000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    real = language_id.fit
    try:
        language_id.fit = lambda samples, *a, **k: seen.append(samples) or real({}, 0)
        train(docs.repartition(3)), train(docs.repartition(7, "text"))
    finally:
        language_id.fit = real
    assert seen[0] == seen[1] and {k: len(v) for k, v in seen[0].items() if k == "en"} == {"en": 300}
    assert len(seen[0]["de"]) >= 25 and len(seen[0]["fr"]) > 120
    assert all(len(t.encode()) <= SAMPLE["bytes"] for v in seen[0].values() for t in v)


def test_the_score_decides_and_nothing_learned_drops_no_text(corpus):
    model = train(corpus)
    verdict = predict(corpus.selectExpr("count doc_id", "text"), model).collect()
    bound = sorted(r.score for r in verdict if r.lang_pred != "und")[len(verdict) // 3]
    kept = {r["count"] for r in accepted(corpus, least=bound).collect()}
    assert kept == {r.doc_id for r in verdict if r.lang_pred != "und" and r.score >= bound} and 0 < len(kept) < len(verdict) - 5
    plain = corpus.withColumn("lang", F.lit(None).cast("string"))
    lettered = {r["count"] for r in corpus.collect() if r.text and any(map(str.isalpha, r.text))}
    assert {r["count"] for r in accepted(plain).collect()} == lettered and accepted(plain).columns == corpus.columns


def test_a_mix_without_a_main_language_goes(spark):
    pools = {"en": "the of and that with", "de": "der die und nicht straße", "fr": "le la des une être", "es": "el los una por que"}
    rows = [(i, pools[k] + " " + pools[k], k) for k in pools for i in range(40)]
    mixed = [(1000 + i, " ".join(pools.values()), None) for i in range(4)]
    ids = {r.doc_id for r in accepted(spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")).collect()}
    assert ids == set(range(40))
