import hashlib

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

from codexa.llm.byte_bpe import Tokens, _Block, decode, encode, encoded_digests, read_ranks  # noqa: E402
from codexa.llm.common import bounded, settle  # noqa: E402

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


@pytest.mark.parametrize("limit", [24_000_000, 300])
def test_ids_equal_the_library_and_decode_to_the_text(corpus, rows, plain, limit):
    coded = encode(corpus, PATH, PATTERN, limit=limit, buckets=7)
    got = sorted((str(r.doc_id), r.ids) for r in coded.collect())
    assert got == sorted((str(i), plain.encode_ordinary(t or "")) for i, t in rows)
    if limit == 300:
        back = sorted((str(r.doc_id), bytes(r.bytes)) for r in decode(coded, PATH).collect())
        assert back == sorted((str(i), (t or "").encode()) for i, t in rows)


def test_odd_characters(spark, plain):
    texts = ["a  b c  d\x1ce\x85f ", "'s''ll  x\n\n y", "\U0001f600́é½٣ ", "   ", " ᠎x​", "don't 'VE we'Re", "\t\t\n x"]
    got = {r.doc_id: r.ids for r in encode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), PATH, PATTERN).collect()}
    assert got == {i: plain.encode_ordinary(t) for i, t in enumerate(texts)}


def test_digests_and_empty_tables(corpus, rows, nothing, plain):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encoded_digests(corpus).collect())
    want = []
    for i, t in rows:
        ids = plain.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert encode(nothing, PATH, PATTERN).count() == 0
    with pytest.raises(ValueError, match="vocabulary"):
        Tokens({b"a": 0, b"b": 5}).decode(np.array([3]))


def test_parquet_is_read_in_pieces_unless_the_user_says_otherwise(spark):
    own, other = spark.newSession(), spark.newSession()
    own.conf.set("parquet.hadoop.vectored.io.enabled", "true")
    assert [bounded(s.range(1)).sparkSession.conf.get("parquet.hadoop.vectored.io.enabled") for s in (own, other)] == ["true", "false"]


def test_row_groups_are_small_unless_the_user_says_otherwise(spark):
    """A task holds a row group that it writes, and a row group's texts that it reads."""
    sizes = []
    for own in (None, "200000000"):
        session = spark.newSession()
        if own:
            session.conf.set("parquet.block.size", own)
        table = settle(session.range(0, 4_000, 1, 1).selectExpr("id", "concat_ws('', transform(sequence(1, 300), i -> sha2(concat(id, ':', i), 256))) text"))
        found = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in table.inputFiles()]
        sizes.append([m.row_group(i).total_byte_size for m in found for i in range(m.num_row_groups)])
    assert len(sizes[0]) > 2 and len(sizes[1]) == 1 and sum(sizes[1]) > 70_000_000


def test_a_block_holds_its_distinct_words_not_its_text():
    words = [f" word{i % 10:0200}" for i in range(100_000)]
    held = pa.total_allocated_bytes()
    block = _Block()
    for i in range(0, 100_000, 1000):
        batch = pa.record_batch([pa.array([i]), pa.array([words[i : i + 1000]])], ["doc_id", "words"])
        block.add(batch.column("doc_id"), batch.column("words"))
        block.add(batch.column("doc_id").slice(1), batch.column("words").slice(1))
    del batch
    assert block.size == sum(map(len, words)) and block.docs[2][0].to_pylist() == [1000]
    assert pa.total_allocated_bytes() - held < 5_000_000
    _, distinct, bucket, numbers = block.numbered(3)
    assert [w.decode() for w in distinct.take(pa.array(numbers)).to_pylist()] == words and (np.diff(bucket) >= 0).all()


def test_decoding_takes_memory_by_the_piece():
    tokens = Tokens({bytes([i]) * 8: i for i in range(256)})
    ids = np.arange(1_000_000, dtype=np.uint32) % 251
    tracemalloc.start()
    data, sizes = tokens.decode(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert data.tobytes() == bytes(np.repeat(np.arange(1_000_000) % 251, 8).astype(np.uint8)) and len(sizes) == 1_000_000
    assert peak < 80_000_000
