import hashlib

import __spark_entry__
import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from codexa.llm.byte_bpe import read_ranks
from codexa.llm.simhash_dedup import fingerprint
from codexa.llm.registry import oracle_sql, queries


@pytest.fixture(scope="module")
def stored(corpus, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    corpus.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_stages_keep_the_columns_and_only_drop_what_they_should(spark, stored):
    docs = spark.read.parquet(f"{stored}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, stored)
        out.write.parquet(f"{stored}/{name}.parquet")
        out = spark.read.parquet(f"{stored}/{name}.parquet")
        assert out.columns == docs.columns
        sizes.append(out.count())
        docs = out
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 40
    marks = [fingerprint(r.text.encode()) for r in spark.read.parquet(f"{stored}/near_duplicates.parquet").collect()]
    assert len(set(marks)) == len(marks)
    mixed = docs.groupBy("doc_id").count().collect()
    assert max(r["count"] for r in mixed) == 2
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    last = sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.STAGES[-1][1](spark, docs, stored).collect())
    assert last == sorted((r.doc_id, len(plain.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in docs.collect())
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, stored).collect()) == last


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in queries()} == {f"op{n}" for n in range(1, 11)}
    assert set(oracle_sql()) <= set(queries())
    assert {*queries(), "pipeline"} <= set(__spark_entry__.queries()) and set(oracle_sql()) <= set(__spark_entry__.oracle_sql())


def test_the_language_stage_goes_by_the_random_field_not_by_letters(spark):
    """A text of four languages in equal parts has letters enough, and goes."""
    pools = {"en": "the of and that with", "de": "der die und nicht straße", "fr": "le la des une être", "es": "el los una por que"}
    rows = [(i, f"{words} {words}", k, "s", 0) for k, words in pools.items() for i in range(40)] + [(1000 + i, " ".join(pools.values()), None, "s", 0) for i in range(3)] + [(2000, "12 ?", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["language_id"](spark, docs, "").collect()}
    lettered = {r[0] for r in rows if any(map(str.isalpha, r[1]))}
    assert kept == set(range(40)) and lettered - kept == {1000, 1001, 1002}


def test_one_of_equal_rows_stays_whatever_their_order(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", str(i), 0) for i in range(20)] + [(None, None, None, "n", 0)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    first, again = (sorted(map(str, stage(spark, d, "").collect())) for d in (docs, docs.repartition(5)))
    assert first == again and len(first) == 2
