import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with copies, shared passages, repeated lines, nulls, empty and long texts, repeated rows and an extra column."""
    draw = random.Random(7)
    vocabulary = {
        "en": "the of and that with from have this which their would there could other about after house water light people".split(),
        "de": "der die und nicht mit sich auch eine einer wird durch über können möchte straße wasser licht häuser größer schön".split(),
    }

    def words(lang, n):
        return [draw.choice(vocabulary[lang]) + draw.choice(["", "", "s", "en", "ly", "ung"]) for _ in range(n)]

    def text(lang, lines, width=12):
        return "\n".join(" ".join(words(lang, width)).capitalize() + "." for _ in range(lines))

    passage = text("en", 5)
    rows = []
    for i in range(60):
        lang = ("en", "de")[i % 3 == 0]
        body = text(lang, draw.randrange(1, 9))
        if i % 7 == 0:
            body = body + "\n" + passage + "\n" + text(lang, 2)
        rows.append((i, body, lang, f"src{i % 4}", len(body)))
    rows.append((60, rows[5][1], "en", "src0", 0))  # a copy
    rows.append((61, rows[8][1] + " End.", "en", "src1", 0))  # a near copy
    rows.append((62, None, None, None, None))
    rows.append((63, "", "en", "src1", 0))
    rows.append((64, " \n\t\n ", "en", None, 5))
    rows.append((65, "12 34 !!", None, "src2", 8))
    rows.append((66, ("abc " * 200).strip(), "en", "src2", 0))  # repeats within itself
    rows.append((67, "x" * 900, "en", "src2", 900))
    rows.append((68, "Größe \U0001f600 \x00 ﬁ  z\x1cy", "de", "src3", 0))
    rows.append((None, rows[3][1], "de", "src3", 0))
    rows.append((None, None, "de", "src3", 0))
    rows.append((69, rows[20][1], "en", "src0", 1))
    rows.append((69, rows[20][1], "en", "src0", 1))  # a repeated row
    rows.append((70, text("en", 300), "en", "src0", 1))
    return spark.createDataFrame([(*r, "size", i) for i, r in enumerate(rows)], DOCS + ", size string, count int").repartition(3).cache()


@pytest.fixture(scope="session")
def rows(corpus):
    return [(r.doc_id, r.text) for r in corpus.collect()]


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
