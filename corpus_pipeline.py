"""A corpus pipeline: five stages, each a table of documents written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codexa.llm.byte_bpe import encoded_digests
from codexa.llm.common import settle
from codexa.llm.language_id import accepted
from codexa.llm.line_dedup import without_repeated
from codexa.llm.mixing import PRODUCTION, mixed
from codexa.llm.near_copies import labelled
from codexa.llm.simhash_dedup import first_of

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no letter (null, empty), or no language with half of the words' probability by the random field."""
    return accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier window of three go; n_chars follows; a document that loses all its lines goes.

    Null, empty and blank texts stay as they are; of repeated rows all count as one document.
    """
    return without_repeated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose shingles of five words have a Jaccard similarity of 0.8 or more, also by way of others, the one of smallest doc_id stays.

    Candidates are the links of SimHash fingerprints that the trie self-join finds, and, as it cannot find all at this
    similarity, pairs that meet in MinHash bands; each is checked on its shingles. Null and empty texts are one group;
    of repeated rows one stays.
    """
    return first_of(docs, labelled(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none to two times.

    Null sources are a source of their own; rows without words weigh nothing and are taken as often as others of
    their source; repeated rows are rows like any other; no rows give none.
    """
    return mixed(docs, **PRODUCTION)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row and what they decode to, as digests.

    A row for each row, repeated ones included; a null or empty text has no ids. docs is read from files, as run() and
    any reader of the stage before do.
    """
    return encoded_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("byte_bpe", byte_bpe),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs)
    return docs
