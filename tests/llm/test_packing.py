from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from orderlens.llm import packing
from orderlens.llm.common import table


def whole_ids(text):
    tokenizer = packing.encoder(packing.tokenizer_path()).whole
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, docs, capacity=packing.CAPACITY):
    """Pieces rebuild every document's ids; sequences are gapless and within capacity."""
    pieces = sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = []
    for doc, text in docs:
        ids = whole_ids(text)
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((str(doc), k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert pieces == sorted(want)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_ids_equal_the_library():
    own = packing.encoder(packing.tokenizer_path())
    rnd = random.Random(1)
    texts = [
        "<|endoftext|> a<|startoftext|>b", "ＡＢＣ ﬁ İstanbul ΣΑΣ ς", "a\x1cb\x85c\xa0d e", "it's don't we'LL I'D 's",
        "x²³ ½ 12345 ①", "é ́a ŉ ĳ Ÿ ƀ ß ẞ", "日本語 テスト", "\x00\x01 ​", "ſ µ ª º ·×÷ ¡¿", "ÀÉ×Ø'Re ‘s", "…", " ", "",
    ]
    texts += ["".join(rnd.choice("abzAZ'sStlLeERdD09 \n.,$<|>éÉßñ×÷ªµ¾·") for _ in range(40)) for _ in range(500)]
    texts += [chr(c) + "a" + chr(c).upper() + " " + chr(c) for c in range(1, 0x400)]
    for text in texts:
        assert np.frombuffer(own.ids(text.encode()), "<u4").tolist() == whole_ids(text)[:-1], repr(text)


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = packing.pack_documents(docs).collect()
    used = check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    least = -(-sum(r.length for r in rows) // packing.CAPACITY)
    assert used <= least + 1


@pytest.mark.parametrize("kind", ["string", "long"])
def test_ids_of_documents_stay_as_they_are(spark, kind):
    ids = ["a-1", "02", "2", None] if kind == "string" else [(1 << 62) + 1, (1 << 53) + 1, -5, None]
    rows = [(i, "some words " * 900) for i in ids]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    found = packing.pack_documents(docs)
    assert found.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    check(found.collect(), rows)


def test_long_chunks_are_not_kept():
    own = packing.Encoder(packing.tokenizer_path())
    texts = ["x" * 5000, "日本語テスト" * 300, "ab" + "-é" * 400, " ".join("y" * n for n in range(250, 260))]
    for text in texts:
        assert np.frombuffer(own.ids(text.encode()), "<u4").tolist() == whole_ids(text)[:-1]
    assert max(map(len, own.chunks)) <= packing.CACHED_BYTES >= max(map(len, own.parts))


def test_odd_rows(odd, nothing):
    rows = packing.pack_documents(odd).collect()
    check(rows, [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.pack_documents(nothing).collect() == []


def test_small_shards_stay_valid(odd):
    pieces = packing.token_pieces(odd, capacity=64)
    rows = packing.best_fit(pieces, 64, shard_pieces=5).collect()
    check(rows, [(r.doc_id, r.text) for r in odd.collect()], 64)


@pytest.mark.parametrize("criterion", ["norm", "dot"])
def test_every_capacity_holds(criterion):
    lengths = np.random.default_rng(3).integers(1, 100, 500)
    bins = packing.pack(lengths, 100, max_documents=3, max_attention=6000 + 99 * 99, criterion=criterion)
    assert np.bincount(bins, lengths).max() <= 100
    assert np.bincount(bins).max() <= 3
    assert np.bincount(bins, lengths**2).max() <= 6000 + 99 * 99
    with pytest.raises(ValueError):
        packing.pack(lengths, 50)
    assert len(packing.pack(np.array([], np.int64))) == 0


def test_close_to_the_least_number_of_sequences():
    lengths = np.random.default_rng(5).integers(1, 2049, 3000)
    bins = packing.pack(lengths)
    assert bins.max() + 1 <= 1.02 * -(-lengths.sum() // 2048) + 1
    assert sorted(set(bins)) == list(range(bins.max() + 1))
