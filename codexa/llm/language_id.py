"""Language identification: a linear-chain conditional random field over words.

A word's features are the byte n-grams of the word with its ends marked (those
that touch an end are its affixes) and the word itself, the lexicon entry, all
hashed into a table of fixed size. Transitions between labels are learned on
sequences put together from two passages, so that they cover a switch of
language. Forward-backward gives each word's label probabilities; a document's
language is the one with the largest mean probability, which is its score.

Whole texts are labelled. Words of a batch are scored once each; the recursions
run over all passages of a batch side by side and are exact: a passage of up to
STEP words is first turned into one transfer matrix, the document's ends are
propagated through these, and then each passage is run from its own ends.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexa.llm.common import bounded, part, pieces, release

HASHED = 1 << 17
NGRAMS = (1, 2, 3, 4, 5)
STEP = 64
#: The bounded training sample: documents of a language (about), longest passage in bytes, words of a document, words of a sequence, sequences.
SAMPLE = {"docs": 300, "bytes": 20_000, "words": 160, "length": 32, "sequences": 2_400}
ROUNDS = 40
#: Text labelled at once, in bytes.
BATCH = 2_000_000
UNKNOWN = "und"
#: Mean probability that a document's language must have, for the document to be accepted.
LEAST = 0.5


@dataclass
class Model:
    """labels; weights[feature, label]; transitions[from, to], logarithmic."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray


def words_of(texts: pa.Array) -> pa.ListArray:
    """Runs of letters (with marks), lowered; empty strings at the ends are left in."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), pattern=r"[^\pL\pM]+", replacement=" ")
    return pc.ascii_split_whitespace(plain)


def _features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words, and where each word's begin; a word has at least one."""
    marked = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(words)), sizes)
    room = ends[of] - np.arange(len(marked))
    found, owner = [], []
    prime, h = np.uint64(0x100000001B3), np.zeros(len(marked), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        h = h[: len(marked) - n + 1] * prime + marked[n - 1 :] + np.uint64(1)
        at = np.flatnonzero(room[: len(h)] >= n)
        mixed = (h[at] + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)
        found.append((mixed >> np.uint64(40)) % np.uint64(HASHED))
        owner.append(of[at])
    whole = np.concatenate(([np.uint64(0)], np.cumsum((marked + np.uint64(7)) * _powers(room))))
    lexicon = (whole[ends] - whole[ends - sizes]) * np.uint64(0xBF58476D1CE4E5B9)
    found.append((lexicon >> np.uint64(40)) % np.uint64(HASHED))
    owner.append(np.arange(len(words)))
    features, owner = np.concatenate(found).astype(np.int64), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return features[order], np.searchsorted(owner[order], np.arange(len(words)))


def _powers(room: np.ndarray) -> np.ndarray:
    """A fixed odd factor to the power of each number."""
    top = int(room.max(initial=0)) + 1
    table = np.cumprod(np.full(top, 0x5851F42D4C957F2D, np.uint64))
    return table[room]


def emissions(words: list[bytes], weights: np.ndarray, features=None) -> np.ndarray:
    """Score of each word and label."""
    if not words:
        return np.zeros((0, weights.shape[1]))
    found, begins = features or _features(words)
    return np.add.reduceat(weights[found], begins, axis=0, dtype=np.float64)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(x.sum(axis=-1, keepdims=True), 1e-300)


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, step: int = STEP) -> np.ndarray:
    """Label probabilities of all words of documents that stand one after another; lengths over 0."""
    forward, backward, _ = messages(scores, lengths, transitions, step)
    return _normal(forward * backward)


def messages(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word, up to factors of its own: what comes from the left with the word itself, what comes from the right, the word.

    A document starts from equal weights, one transition before its first word.
    """
    n, labels = scores.shape
    if not n:
        return scores, scores, scores
    move = np.exp(transitions - transitions.max())
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    per = -(-lengths // step)
    doc = np.repeat(np.arange(len(lengths)), per)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    starts = np.repeat(np.cumsum(lengths) - lengths, per) + rank * step
    sizes = np.minimum(step, np.repeat(lengths, per) - rank * step)
    inside = np.arange(step) < sizes[:, None]
    at = np.where(inside, starts[:, None] + np.arange(step), 0)
    emit = local[at]
    whole = np.broadcast_to(np.eye(labels), (len(doc), labels, labels)).copy()
    for t in range(step):
        live = inside[:, t]
        if not live.any():
            break
        new = (whole[live] @ move) * emit[live, t, None, :]
        whole[live] = new / new.max(axis=(1, 2), keepdims=True)
    first = np.cumsum(per) - per
    forward, backward = np.empty((len(doc), labels)), np.empty((len(doc), labels))
    now = np.full((len(lengths), labels), 1.0 / labels)
    by_size = np.argsort(-per, kind="stable")
    for k in range(int(per.max())):
        who = by_size[: np.searchsorted(-per[by_size], -k, side="left")]
        c = first[who] + k
        forward[c] = now[who]
        now[who] = _normal(np.einsum("ci,cij->cj", now[who], whole[c]))
    now = np.full((len(lengths), labels), 1.0 / labels)
    for k in range(int(per.max())):
        who = by_size[: np.searchsorted(-per[by_size], -k, side="left")]
        c = first[who] + per[who] - 1 - k
        backward[c] = now[who]
        now[who] = _normal(np.einsum("cij,cj->ci", whole[c], now[who]))
    alpha = np.empty_like(emit)
    state = forward
    for t in range(step):
        state = _normal((state @ move) * emit[:, t])
        alpha[:, t] = state
    beta, state = np.empty_like(emit), backward
    for t in range(step - 1, -1, -1):
        beta[:, t] = state
        earlier = _normal((emit[:, t] * state) @ move.T)
        state = np.where(inside[:, t, None], earlier, state)
    return alpha[inside], beta[inside], local


def _sequences(samples: dict[str, list[str]], length: int, words: int, count: int, seed: int):
    """Word sequences with their labels; each is put together from two passages."""
    draw = random.Random(seed)
    pool: dict[int, list[list[bytes]]] = {}
    for k, lang in enumerate(sorted(samples)):
        texts = words_of(pa.array(samples[lang], pa.string())).to_pylist()
        pool[k] = []
        for found in texts:
            own = [w.encode() for w in found if w]
            begin = draw.randrange(max(1, len(own) - words + 1))
            pool[k] += [p for i in range(begin, min(len(own), begin + words), length) if (p := own[i : i + length])]
    pool = {k: v for k, v in pool.items() if v}
    rows, marks = [], []
    kinds = sorted(pool)
    for i in range(count if kinds else 0):
        a = kinds[i % len(kinds)]
        b = draw.choice(kinds) if draw.random() < 0.5 else a
        left, right = draw.choice(pool[a]), draw.choice(pool[b])
        cut = draw.randrange(1, length + 1)
        row = (left[:cut] + right)[:length]
        rows.append(row)
        marks.append(([a] * len(left[:cut]) + [b] * len(right))[:length])
    return rows, marks


def fit(samples: dict[str, list[str]], seed: int = 0, rounds: int = ROUNDS, length: int = SAMPLE["length"], words: int = SAMPLE["words"], count: int = SAMPLE["sequences"]) -> Model:
    """Maximum likelihood with a quadratic penalty, by Adam on all sequences; texts by language."""
    labels = sorted(samples)
    rows, marks = _sequences(samples, length, words, count, seed)
    width = len(labels)
    weights, moves = np.zeros((HASHED, width)), np.zeros((width, width))
    if not rows:
        return Model([], weights[:, :0], moves[:0, :0])
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for r in rows for w in r))}
    ids = np.array([vocabulary[w] for r in rows for w in r])
    gold = np.array([m for r in marks for m in r])
    lengths = np.array([len(r) for r in rows])
    features = _features(list(vocabulary))
    owner = np.repeat(np.arange(len(vocabulary)), np.diff(np.append(features[1], len(features[0]))))
    used, slot = np.unique(features[0], return_inverse=True)
    last = np.cumsum(lengths) - 1
    inner = np.ones(len(ids), bool)
    inner[last] = False
    left = np.flatnonzero(inner)
    seen_moves = np.zeros((width, width))
    np.add.at(seen_moves, (gold[left], gold[left + 1]), 1)
    small = np.zeros((len(used), width))
    state = {"w": [np.zeros_like(small), np.zeros_like(small)], "m": [np.zeros_like(moves), np.zeros_like(moves)]}

    def adam(name, value, gradient, k, rate=0.15):
        m, v = state[name]
        m += 0.1 * (gradient - m)
        v += 0.01 * (gradient**2 - v)
        return value - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)

    onehot = np.eye(width)[gold]
    for k in range(1, rounds + 1):
        scores = np.add.reduceat(small[slot], features[1], axis=0)[ids]
        forward, backward, local = messages(scores, lengths, moves, step=length)
        p = _normal(forward * backward)
        push = np.zeros((len(vocabulary), width))
        for j in range(width):
            push[:, j] = np.bincount(ids, weights=p[:, j] - onehot[:, j], minlength=len(vocabulary))
        gradient = np.stack([np.bincount(slot, weights=push[owner, j], minlength=len(used)) for j in range(width)], axis=1)
        pair = forward[left][:, :, None] * np.exp(moves - moves.max())[None] * (local * backward)[left + 1][:, None, :]
        pair /= np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-300)
        small = adam("w", small, gradient / len(ids) + 1e-6 * small, k)
        moves = adam("m", moves, (pair.sum(axis=0) - seen_moves) / len(ids) + 1e-5 * moves, k)
    weights[used] = small
    return Model(labels, weights.astype(np.float32), moves)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learned from; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, sample: dict = SAMPLE, seed: int = 0) -> Model:
    """Learn from documents(doc_id, text, lang) that are not held out and have a lang and a letter.

    The sample is bounded by `sample`: of each language about that many distinct documents, picked
    by a hash of id and text over the whole table; of a longer text a passage of at most its bytes,
    from a place that the hash gives. Same rows, same sample, in any order and partitioning.
    """
    usable = bounded(docs).where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = usable.select("lang", "text", F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "text").alias("hash"))
    counts = hashed.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("n")).collect()  # one row for each language
    if not counts:
        return fit({}, seed)
    # twice as many as are wanted, of which the first of each language stay
    every = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], max(1, r["n"] // (2 * sample["docs"])))])
    picked = hashed.where(F.pmod("hash", every[F.col("lang")]) == 0)
    size = max(1, sample["bytes"] // 4)  # characters that never have more bytes
    at = F.pmod(F.xxhash64("hash"), F.greatest(F.lit(1), F.char_length("text") - size + 1)).cast("int") + 1
    passage = F.when(F.octet_length("text") <= sample["bytes"], F.col("text")).otherwise(F.substring("text", at, F.lit(size)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash"))
    rows = picked.select("lang", "hash", passage.alias("text")).dropDuplicates(["lang", "hash"]).withColumn("rank", rank).where(F.col("rank") <= sample["docs"]).collect()
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.rank)):
        texts.setdefault(r.lang, []).append(r.text)
    return fit(texts, seed, length=sample["length"], words=sample["words"], count=sample["sequences"])


def _batch_marginals(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Documents with words and their lengths, the distinct words, each word's number; then probabilities."""
    split = words_of(texts)
    flat = split.flatten()
    owner = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    coded = flat.dictionary_encode()
    good = pc.match_substring_regex(coded.dictionary, r"\pL").to_numpy(zero_copy_only=False).astype(bool)
    numbers = coded.indices.to_numpy(zero_copy_only=False)
    keep = good[numbers] if len(numbers) else np.zeros(0, bool)
    return owner[keep], numbers[keep], coded.dictionary, good


def _predict(batches: Iterator[pa.RecordBatch], model, words: bool) -> Iterator[pa.RecordBatch]:
    m: Model = model.value
    for batch in pieces(batches, "text", BATCH):
        owner, numbers, vocabulary, _ = _batch_marginals(batch.column("text"), m)
        n, width = batch.num_rows, max(1, len(m.labels))
        lengths = np.bincount(owner, minlength=n)
        names = np.array([*m.labels, UNKNOWN], object)
        if len(m.labels):
            scores = emissions(vocabulary.cast(pa.large_binary()).to_pylist(), m.weights)[numbers]
            p = marginals(scores, lengths[lengths > 0], m.transitions)
            total = np.stack([np.bincount(owner, weights=p[:, j], minlength=n) for j in range(width)], axis=1)
            best = np.where(lengths > 0, total.argmax(axis=1), len(m.labels))
            score = np.where(lengths > 0, total.max(axis=1) / np.maximum(lengths, 1), 0.0).clip(0, 1)
        else:
            best, score, p = np.zeros(n, int), np.zeros(n), np.zeros((len(owner), 1))
        out = [batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)]
        fields = ["doc_id", "lang_pred", "score"]
        if words:
            offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
            out += [pa.ListArray.from_arrays(offsets, vocabulary.take(pa.array(numbers)).cast(pa.string())), pa.ListArray.from_arrays(offsets, pa.array(names[p.argmax(axis=1)] if len(m.labels) else names[[0] * len(owner)], pa.string()))]
            fields += ["words", "word_langs"]
        yield pa.RecordBatch.from_arrays(out, fields)
        release()


def predict(docs: DataFrame, model: Model, words: bool = False) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, lang_pred, score), with `words` also (words, word_langs).

    One row for each input row; `und` and 0 where the text is null or has no letter, or nothing was learned.
    The model is broadcast: its size is fixed by HASHED and the number of languages.
    """
    kind = dict(docs.dtypes)["doc_id"]
    more = ", words array<string>, word_langs array<string>" if words else ""
    sent = bounded(docs).sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(part(_predict, model=sent, words=words), f"doc_id {kind}, lang_pred string, score double{more}")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predict(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def _accept(batches: Iterator[pa.RecordBatch], model, least: float) -> Iterator[pa.RecordBatch]:
    """Rows (doc) -> those whose text has a language with `least` of the probability."""
    texts = (pa.RecordBatch.from_arrays([b.column("doc"), b.column("doc").field("text")], ["doc_id", "text"]) for b in batches)
    for out in _predict(texts, model, False):
        keep = pc.and_(pc.not_equal(out.column("lang_pred"), UNKNOWN), pc.greater_equal(out.column("score"), least))
        yield pa.RecordBatch.from_arrays([out.column("doc_id").filter(keep)], ["doc"])


def accepted(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents that have a language, columns as they were.

    One without a letter goes, and one whose language has less than `least` of its words' probability:
    noise, or a mix of which no language is a half. Where nothing could be learned, there is no verdict and
    every document with a letter stays. A text goes to Python once, within its row.
    """
    model = train(docs)
    if not model.labels:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = bounded(docs).select(F.struct("*").alias("doc"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(part(_accept, model=sent, least=least), rows.schema).select("doc.*")
