"""Quality by weak supervision: rules vote, expectation-maximisation weighs them.

Each rule votes good or bad or abstains on a document. Only the counts of the
vote patterns leave the executors, at most 3 to the number of rules, whatever
the number of documents; expectation-maximisation on these counts is the same as
on all documents. It estimates the share of good documents and how each rule
votes on good and on bad ones; a document's posterior follows from its pattern.
Documents that fail the base rules outright are left out of the fit, so that the
rules' accuracies are those on the documents that remain to be judged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import as_bytes, part, pieces, settle

# The characters that count as symbols, and white space.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"

WINDOW = 8
MIN_WORDS = 20
REPEATED_PERCENT = 30

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_short_ends", "n_stops", "n_letters", "n_again", "n_distinct"]


def _repeat_words(numbers: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """Words of each document that lie in a window of it found twice or more; documents one after another."""
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    if len(numbers) < window:
        return np.zeros(len(lengths), np.int64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    hashed = (numbers.astype(np.uint64) + np.uint64(1)) * factor
    hashed ^= hashed >> np.uint64(29)
    mixed = np.zeros(len(numbers) - window + 1, np.uint64)
    for i in range(window):
        mixed = mixed * np.uint64(0xD6E8FEB86659FD93) + hashed[i : len(hashed) - window + 1 + i]
    starts = np.flatnonzero(np.arange(len(mixed)) + window <= ends[doc[: len(mixed)]])
    key = mixed[starts] + doc[starts].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return np.zeros(len(lengths), np.int64)
    # verify on the words themselves; hashes only narrow the search
    groups: dict[tuple, list[int]] = {}
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    for s in starts[order[twice]].tolist():
        groups.setdefault((int(doc[s]), numbers[s : s + window].tobytes()), []).append(s)
    mark = np.zeros(len(numbers) + 1, np.int64)
    for found in groups.values():
        if len(found) > 1:
            np.add.at(mark, found, 1)
            np.add.at(mark, [s + window for s in found], -1)
    inside = np.cumsum(mark[:-1]) > 0
    return np.bincount(doc[inside], minlength=len(lengths))


def _measure(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten()
        owner = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        coded = flat.dictionary_encode()
        full = pc.greater(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
        numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        keep = full[numbers] if len(numbers) else np.zeros(0, bool)
        owner, numbers = owner[keep], numbers[keep]
        n = batch.num_rows
        lengths = np.bincount(owner, minlength=n)
        chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        letters = pc.utf8_length(pc.replace_substring_regex(texts, pattern=r"[^\pL]+", replacement="")).to_numpy(zero_copy_only=False)
        count = lambda s: pc.count_substring(texts, pattern=s).to_numpy(zero_copy_only=False).astype(np.int64)
        blank = sum(count(c) for c in SPACE)
        symbols = sum(count(c) for c in SYMBOLS)
        short = pc.less_equal(pc.utf8_length(coded.dictionary), 3).to_numpy(zero_copy_only=False)
        stops = np.bincount(owner[short[numbers]], minlength=n) if len(numbers) else np.zeros(n, np.int64)
        again = np.bincount(owner[1:][(numbers[1:] == numbers[:-1]) & (owner[1:] == owner[:-1])], minlength=n)
        pairs = np.unique(owner * max(1, len(coded.dictionary)) + numbers) // max(1, len(coded.dictionary))
        distinct = np.bincount(pairs, minlength=n)
        dup, lines, ends = [], [], []
        for text in as_bytes(batch.column("text")):
            own = [x for x in text.split(b"\n") if x.strip(SPACE.encode())]
            dup.append(len(own) - len(set(own)))
            lines.append(len(own))
            ends.append(sum(not x.rstrip(SPACE.encode()).endswith((b".", b"!", b"?", b":", b'"', b"'", b")", b"\xe2\x80\x9d", b"\xc2\xbb")) for x in own))
        columns = [lengths, chars - blank, symbols, dup, lines, _repeat_words(numbers, lengths, window), ends, stops, letters, again, distinct]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.asarray(c), pa.int64()) for c in columns)], ["doc_id", *MEASURES])


def measures(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents(doc_id, text) -> doc_id and MEASURES, a row for each input row; null texts count as empty."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(part(_measure, window=window), f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(value: Column, good: Column, bad: Column) -> Column:
    """1 for good, -1 for bad, 0 to abstain."""
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def rules() -> dict[str, Column]:
    """The rules as votes over MEASURES."""
    mean, symbols, dups = _share("word_chars", "n_words"), _share("n_symbols", "n_words"), _share("n_dup_lines", "n_lines")
    repeated, ends, stops = _share("n_repeat_words", "n_words"), _share("n_short_ends", "n_lines"), _share("n_stops", "n_words")
    varied = _share("n_distinct", "n_words")
    again, letters, enough = _share("n_again", "n_words"), _share("n_letters", "word_chars"), F.col("n_words") >= MIN_WORDS
    return {
        "length": _vote(F.col("n_words"), F.col("n_words") >= 50, F.col("n_words") < MIN_WORDS),
        "mean_word": _vote(mean, mean.between(3.5, 7.5), (mean < 3) | (mean > 10)),
        "symbols": _vote(symbols, symbols <= 0.02, symbols > 0.1),
        "dup_lines": _vote(dups, enough & (dups == 0), dups > 0.3),
        "repeats": _vote(repeated, enough & (repeated <= 0.05), repeated > REPEATED_PERCENT / 100),
        "line_ends": _vote(ends, enough & (ends <= 0.1), enough & (ends > 0.5)),
        "short_words": _vote(stops, enough & (stops >= 0.12), enough & (stops < 0.04)),
        "same_word": _vote(again, enough & (again <= 0.05), again > 0.2),
        "varied": _vote(varied, enough & (varied >= 0.35), varied < 0.25),
        "letters": _vote(letters, letters >= 0.93, letters < 0.9),
    }


#: What is believed of a rule's votes (bad, good) before any document is seen: on good documents, on bad ones.
ON_GOOD, ON_BAD = (0.02, 0.98), (0.4, 0.6)
#: Weight of that belief against the documents, as a share of their number.
BELIEF = 0.05


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 300, prior: float = 0.9) -> tuple[float, np.ndarray, np.ndarray]:
    """Vote patterns and their counts -> share of good documents, each rule's votes given good, given bad.

    A rule's accuracy is over the documents on which it votes; to abstain says nothing.
    """
    good, bad = np.array(ON_GOOD), np.array(ON_BAD)
    if not patterns:
        return prior, good[None], bad[None]
    votes = np.array([p for p, _ in patterns])
    counts = np.array([c for _, c in patterns], float)
    onehot = np.stack([votes == v for v in (-1, 1)], axis=2).astype(float)
    on_good, on_bad, share = np.tile(good, (votes.shape[1], 1)), np.tile(bad, (votes.shape[1], 1)), prior
    strength = 1 + BELIEF * counts.sum()
    for _ in range(rounds):
        p = posterior(votes, share, on_good, on_bad)
        before = share
        for table, weight, belief in ((on_good, p, strength * prior * good), (on_bad, 1 - p, strength * (1 - prior) * bad)):
            seen = np.einsum("p,prv->rv", counts * weight, onehot) + belief
            table[:] = seen / seen.sum(axis=1, keepdims=True)
        share = float(np.clip((counts * p).sum() / counts.sum(), 0.01, 0.99))
        if abs(share - before) < 1e-10:
            break
    return share, on_good, on_bad


def posterior(votes: np.ndarray, share: float, on_good: np.ndarray, on_bad: np.ndarray) -> np.ndarray:
    """Probability of good for each pattern of votes."""
    onehot = np.stack([votes == v for v in (-1, 1)], axis=2).astype(float)
    good = math.log(share) + (onehot * np.log(on_good)).sum(axis=(1, 2))
    bad = math.log(1 - share) + (onehot * np.log(on_bad)).sum(axis=(1, 2))
    return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def judge(rows: DataFrame, among: Column | None = None, votes: dict[str, Column] | None = None) -> DataFrame:
    """Rows with MEASURES -> the same with votes and quality, the posterior probability of good.

    The fit is over all rows for which `among` holds (all rows if not given); every row gets a quality.
    The table of patterns is broadcast: it has at most 3 to the number of rules rows.
    """
    votes = rules() if votes is None else votes
    voted = rows.withColumn("votes", F.struct(*[v.alias(n) for n, v in votes.items()]))
    counts = voted.groupBy("votes").agg(F.sum((F.lit(True) if among is None else among).cast("long")).alias("n")).collect()
    patterns = sorted((tuple(r["votes"]), r["n"]) for r in counts)
    fitted = fit([p for p in patterns if p[1]])
    found = posterior(np.array([p for p, _ in patterns]), *fitted).tolist() if patterns else []
    kind = ", ".join(f"{n}: int" for n in votes)
    table = rows.sparkSession.createDataFrame([(p, q) for (p, _), q in zip(patterns, found, strict=True)], f"pattern struct<{kind}>, quality double")
    return voted.join(F.broadcast(table), F.col("votes") == F.col("pattern")).drop("pattern")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = judge(settle(measures(docs)), among=~base_failed()).withColumn("base_failed", base_failed())
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("quality") >= 0.5)).alias("kept"), "quality",
    )
