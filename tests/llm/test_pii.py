import hashlib
import random
import re
import time
from collections import Counter

import pytest

from codexa.llm.pii import ACCURACY, KINDS, LABELERS, base_spans, chance, features, luhn, masked, op5_pii, personal_data, reliabilities, train, votes, wide_spans

TEXT = "a.b@c.d.org x@y 1.2.3.4 1.2.3.456, 4111 1111 1111 1111, 4111111111111112, +1 (487) 555-7209 +1 2"


def brute(text):
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def check_digit(digits):
    return next(d for d in "0123456789" if luhn(digits + d))


def planted(n, seed):
    """Texts with personal data that the base patterns miss, and with numbers and names that look alike; (text, start, end) of the former."""
    draw = random.Random(seed)
    num = lambda k: "".join(draw.choice("0123456789") for _ in range(k))
    pick = draw.choice
    name = lambda: pick(["bob", "j.doe", "anna_lee", "info", "k.smith"])
    hexa = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))
    words = "the of and water light house people there about after which would time small".split()

    def iban():
        body, country = num(18), "DE"
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"[:22], country

    def amex():
        body = pick(["34", "37"]) + num(12)
        return body + check_digit(body)

    def good():
        card, account = amex(), iban()[0]
        return pick(
            [
                ("mail me:", f"{name()} (at) {pick(['example', 'firm-x', 'web'])} (dot) {pick(['com', 'org', 'de'])}"),
                ("contact", f"{name()} at {pick(['example', 'firm', 'web'])} dot {pick(['com', 'org', 'net'])}"),
                ("e-mail", f"{name()}[at]{pick(['example', 'web'])}.{pick(['com', 'org'])}"),
                (pick(["call", "phone", "tel:", "fax"]), f"({num(3)}) {pick('23456')}{num(2)}-{num(4)}"),
                (pick(["call", "mobile", "phone:"]), f"{pick('23456789')}{num(2)}-{pick('23456')}{num(2)}-{num(4)}"),
                (pick(["Tel.", "Telefon", "phone"]), f"0{pick('123456789')}{num(2)} {pick('123456789')}{num(6)}"),
                (pick(["amex", "card", "charged to"]), f"{card[:4]} {card[4:10]} {card[10:]}"),
                ("card:", card),
                (pick(["host", "server", "from"]), ":".join(hexa(4) for _ in range(8))),
                (pick(["iban", "account", "transfer to"]), " ".join(account[i : i + 4] for i in range(0, 22, 4))),
                ("konto", account),
                (pick(["ssn", "social security", "ssn:"]), f"{draw.randrange(100, 600)}-{draw.randrange(10, 99)}-{draw.randrange(1000, 9999)}"),
                (pick(["token =", 'api_key = "', "password:", "secret="]), pick([hexa(40), "AKIA" + "".join(pick("ABCDEFGHJKLMNPQ2345670") for _ in range(16)), "ghp_" + "".join(pick("abcXYZ0189") for _ in range(36))])),
            ]
        )

    def bad():
        return pick(
            [
                ("version", f"{num(3)}-{num(3)}-{num(4)}"), ("order", num(16)), ("order", "#" + num(16)), ("invoice", f"{num(4)} {num(4)} {num(4)} {num(4)}"), ("we met bob at", "noon there"), ("between", "2001-2004 1999"),
                ("commit", hexa(40)), ("sha256", hexa(64)), ("isbn", f"978-3-16-{num(6)}-{num(1)}"), ("date", f"20{num(2)}-{num(2)}-{num(2)}"), ("part", f"{num(3)}-{num(2)}-{num(4)}"),
                ("file", "some_long_path/of_words/in_a_tree1"), ("uuid", f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}"), ("serial", f"AB{num(2)} {num(4)} {num(4)} {num(4)}"), ("at", "12:30:45"),
                ("page", f"{num(3)} {num(3)} {num(4)}"), ("model", f"{num(4)}-{num(6)}-{num(5)}"),
            ]
        )

    texts, truth = [], set()
    for i in range(n):
        parts = [" ".join(pick(words) for _ in range(draw.randrange(3, 9)))]
        for _ in range(draw.randrange(0, 4)):
            true = draw.random() < 0.5
            cue, value = good() if true else bad()
            parts.append(" " + cue + ("" if cue[-1] in '"=' else " "))
            at = sum(map(len, parts))
            if true:
                truth.add((i, at, at + len(value)))
            parts += [value, '"' if cue[-1] == '"' else "", " " + " ".join(pick(words) for _ in range(draw.randrange(2, 7)))]
        texts.append("".join(parts))
    return texts, truth


def test_base_spans_equal_plain_patterns(rows):
    draw = random.Random(1)
    texts = [TEXT, "é@x.de 00001.2.3.4 " + "9" * 5000 + " 0" * 6000, "", "+49 30 1234567, +49 (0)", "1-2 3-4 1234-5678-9012-3452x4", "1.2.3.4.5.6.7.8@x.de a.b@c@d.e@f.g a@b.c@d.e"]
    texts += ["".join(draw.choice("aZ0199..@@-+ ()%é:") for _ in range(draw.randrange(1, 60))) for _ in range(4000)]
    for t in [*texts, *(t or "" for _, t in rows)]:
        assert base_spans(t) == brute(t)
    assert [k for k, _, _ in base_spans(TEXT)] == ["email", "ip", "card", "phone"]


@pytest.mark.parametrize("unit", ["1", "a", "a@", "1.1", "+1 ", "a.b@c.d ", "1234 ", "(at) ", "f:", "ab12", "12-"])
def test_a_megabyte_takes_seconds(unit):
    text = unit * (1_000_000 // len(unit))
    begin = time.process_time()
    wide_spans(text, base_spans(text))
    assert time.process_time() - begin < 4


def test_added_spans_have_precision_and_recall(spark):
    texts, truth = planted(400, 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got, kinds = set(), Counter()
    for r in personal_data(docs).collect():
        base = brute(texts[r.doc_id])
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert r.n_spans == len(spans) and r.n_added == len(spans) - len(base) and set(base) <= set(spans)
        more = set(spans) - set(base)
        got |= {(r.doc_id, a, b) for _, a, b in more}
        kinds.update(k for k, _, _ in more)
    missed = {x for x in truth if not any(k == x[0] and a < x[2] and b > x[1] for k, a, b in got)}
    assert len(got & truth) / len(got) >= 0.9 and 1 - len(missed) / len(truth) >= 0.9
    assert all(kinds[k] > 5 for k in KINDS)


def test_labelers_vote_both_ways_and_reliabilities_follow():
    texts, truth = planted(400, 9)
    seen, cast = Counter(), [set() for _ in LABELERS]
    for t in texts:
        base = base_spans(t)
        for k, a, b, x in [(*s, True) for s in base] + [(*s, False) for s in wide_spans(t, base)]:
            v = votes(k, t, a, b, x)
            seen[k, v] += 1
            for s, one in zip(cast, v, strict=True):
                s.add(one)
    assert all({-1, 1} <= s for s in cast)
    share, rate = reliabilities(sorted((k, v, n) for (k, v), n in seen.items()))
    assert all(0.05 < share[k] < 1 for k in KINDS) and (rate[:, 1] > rate[:, 0]).all()
    empty = reliabilities([])[1]
    assert empty[:, 1].tolist() == list(ACCURACY) and abs(rate - empty).max() > 0.05


def test_the_classifier_reads_text_and_context():
    """Of equal votes, a span whose characters and neighbours are those of likely ones is likelier."""
    vote, other = (1, 0, 0, 0, 1, 0), (1, 0, 0, 1, 1, 0)
    likes = [("phone", other, features("phone", f"xyz call {n}-555-0{n} now", 9, 21, other)) for n in range(200, 240)]
    unlike = [("phone", (-1, 0, 0, -1, -1, 0), features("phone", f"abc order 2001 2002 {n}", 10, 23, (-1, 0, 0, -1, -1, 0))) for n in range(200, 240)]
    seen = [("phone", other, 400), ("phone", (-1, 0, 0, -1, -1, 0), 400), ("phone", vote, 10)]
    w = train(seen, likes + unlike)
    a = chance(w, features("phone", "xyz call 211-555-0211 now", 9, 21, vote))
    b = chance(w, features("phone", "abc order 2001 2002 211", 10, 23, vote))
    assert a > b + 0.1 and train([], []).sum() == 0


def test_every_input_row_has_a_row(spark):
    more = "write to bob (at) example (dot) com or call 487-555-7209, ssn 123-45-6789, iban DE89 3704 0044 0532 0130 00"
    clean = "We met at noon. Version 123-456-7890 of part 12, page 3: a ratio of 1.5 and 3 dot 4."
    docs = spark.createDataFrame([(1, TEXT, "x"), (2, more, "y"), (3, None, None), (4, "", ""), (5, clean, ""), (None, TEXT, ""), (1, TEXT, "x")], "doc_id int, text string, spans string")
    got = personal_data(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and by[3].spans == "" and by[4].base_sha256 == hashlib.sha256(b"").hexdigest()
    line = ",".join(f"{k}:{a}:{b}" for k, a, b in brute(TEXT))
    assert by[1].base_sha256 == hashlib.sha256(line.encode()).hexdigest() and line in by[1].spans
    assert {s.split(":")[0] for s in by[2].spans.split(",")} == {"email", "phone", "ssn", "iban"} and by[2].n_email == 0
    assert by[5].spans == ""
    hidden = {r.doc_id: r.text for r in masked(docs.drop("spans").where("doc_id = 1").dropDuplicates().join(personal_data(docs).dropDuplicates(["doc_id"]), "doc_id").select("doc_id", "text", "spans")).collect()}
    assert hidden[1].startswith("<email> x@y <ip> 1.2.3.456, <card>, 4111111111111112, <phone>")


def test_no_rows_give_no_rows(spark, nothing):
    assert personal_data(nothing).collect() == []


def test_the_query_holds_base_spans_of_every_document(spark, corpus, rows, tmp_path):
    corpus.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.base_sha256, r.n_email) for r in op5_pii(spark, str(tmp_path)).collect())
    line = lambda t: ",".join(f"{k}:{a}:{b}" for k, a, b in brute(t or ""))
    assert got == sorted((str(i), hashlib.sha256(line(t).encode()).hexdigest(), sum(k == "email" for k, _, _ in brute(t or ""))) for i, t in rows)
