"""Token counts and shards against the tokenizer libraries on whole texts."""

import io
import struct
import zlib

import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import sstable
from millrace.llm.common import byte_batches, safe_chunks
from millrace.llm.encoding import HashMemo, json_encoder
from millrace.llm.token_counts import _lengths, count_tokens

from .fixtures import BYTE_BPE, DOCS, PIECES, clashing, corpus, empty

BPE = tokenizers.Tokenizer.from_file(BYTE_BPE)
SP = sentencepiece.SentencePieceProcessor(model_file=PIECES)


def bpe(text):
    return BPE.encode(text or "", add_special_tokens=False).ids


odd = st.lists(st.sampled_from([*"ab .,\n\t'sT1é ▁\x1c　日²_<|>", "<|endoftext|>", "  "]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(odd)
def test_chunks_are_safe(text):
    assert "".join(safe_chunks(text)) == text
    assert _lengths([text], PIECES) == [len(SP.encode(text))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | odd, max_size=6))
def test_ids_of_odd_texts(texts):
    data, edges = json_encoder(BYTE_BPE).encode(pa.array(texts, pa.string()))
    assert [list(struct.unpack(f"<{(b - a) // 2}H", data[a:b])) for a, b in zip(edges.tolist(), edges[1:].tolist())] == [bpe(t) for t in texts]


def test_memo_that_overflows_stays_exact():
    made = []

    def many(chunks):
        made.extend(chunks)
        return pa.array([c.upper().encode() for c in chunks], pa.large_binary())

    memo = HashMemo(many, entries=40, longest=6)
    for k in range(60):
        some = ["often", "toolongtostay", *[f"w{j}" for j in range(k, k + 15)]]
        values, at = memo.lookup(pa.array(some, pa.large_string()))
        assert [values[j].as_py().decode() for j in at.tolist()] == [c.upper() for c in some]
        assert len(memo.known) <= 40 + 17
    assert made.count("often") < 5 and made.count("toolongtostay") == 60


def test_long_shards_are_followed_by_new_ones(spark):
    whole = sstable.encode_to_shards(corpus(spark), BYTE_BPE)
    parts = sstable.encode_to_shards(corpus(spark), BYTE_BPE, block_bytes=512, shard_bytes=1024)
    assert parts.count() > whole.count()
    assert sorted(map(str, sstable.read_shards(parts).collect())) == sorted(map(str, sstable.read_shards(whole).collect()))


def test_batches_are_balanced():
    assert list(byte_batches([], 5)) == []
    assert list(byte_batches([9, 1, 2, 3, 0, 9], 5)) == [(0, 1), (1, 3), (3, 5), (5, 6)]


@pytest.mark.parametrize("path, count", [(PIECES, lambda t: len(SP.encode(t or ""))), (BYTE_BPE, lambda t: len(bpe(t)))])
def test_counts(spark, path, count):
    got = sorted(map(tuple, count_tokens(corpus(spark), path, limit=100).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str)
    assert got == sorted(((d, len((t or "").encode()), n := count(t), n > 100) for d, t, *_ in DOCS), key=str)


def test_counts_of_clashing_and_empty_tables(spark):
    df = count_tokens(clashing(spark), PIECES)
    assert df.count() == len(DOCS) and [c.lower() for c in df.columns].count("n_bytes") == 1 and "lengths" in df.columns
    assert count_tokens(empty(spark), PIECES).count() == 0


def test_shards_round_trip(spark):
    manifest = sstable.encode_to_shards(corpus(spark), BYTE_BPE, block_bytes=512)
    got = [tuple(r) for r in sstable.read_shards(manifest).collect()]
    want, start = [], 0
    for d, t, *_ in sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = bpe(t) + [0]
        want.append((d, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert [len(x) for x in sstable.lookup(manifest, [6, 9, 12345]).values()] == [2, 1]
    assert sstable.lookup(manifest, [8])[8][0].tolist() == [*bpe(DOCS[10][1]), 0]


def test_shards_of_empty_and_clashing_tables(spark):
    assert sstable.read_shards(sstable.encode_to_shards(empty(spark), BYTE_BPE)).count() == 0
    assert sstable.read_shards(sstable.encode_to_shards(clashing(spark), BYTE_BPE)).count() == len(DOCS)


def test_shard_file():
    out = io.BytesIO()
    w = sstable.ShardWriter(out, 2, block_bytes=64)
    keys = [sstable.make_key(k) for k in [None, -(1 << 63), -5, 0, 3, 4, 1000, (1 << 63) - 1]]
    for n, key in enumerate(keys):
        w.add(key, struct.pack("<H", n) * n)
    with pytest.raises(ValueError):
        w.add(keys[0], b"")
    size = w.close()
    assert size == len(out.getvalue())
    r = sstable.ShardReader(out, size)
    assert len(r.index) > 1 and [x for k in range(len(r.index)) for x, _ in r.block(k)] == keys == sorted(keys)
    assert r.get(1000).tolist() == [6] * 6 and r.get(1001) is None and r.get(None).tolist() == []
    damaged = bytearray(out.getvalue())
    damaged[3] ^= 1
    with pytest.raises(ValueError):
        list(sstable.ShardReader(io.BytesIO(bytes(damaged)), size).block(0))


def test_memo_is_thinned_before_a_batch():
    """Not while a caller holds the values, when everything would be there twice."""
    memo = HashMemo(lambda chunks: pa.array([c.encode() for c in chunks], pa.large_binary()), entries=10)
    for k in range(0, 60, 12):
        values, at = memo.lookup(pa.array([f"w{j}" for j in range(k, k + 12)], pa.large_string()))
        assert values is memo.ids and at.max() < len(memo.known)
