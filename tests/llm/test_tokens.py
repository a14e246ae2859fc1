"""Packing and SentencePiece coding."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from fixtures import documents, odd_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cuemill.llm import packing, pieces, queries

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
STRANGE = ["", " ", "a.b,c", "It's we'LL don't O'RE", "क़ख़ abc", "ǅungla ﬁ ß İstanbul ÅÅ", "12ab34 x²", "a\u00a0b\u2003c", "<|endoftext|> <|startoftext|>x", "é e\u0301", "!!!...,,,", "日本語テキスト", "😀😀a", "a\x00b\x85c", "x" * 3000]


def test_ids_of_words():
    own, plain = packing.Words(WORD), Tokenizer.from_file(WORD)
    rng = random.Random(3)
    mixed = [" ".join(rng.choice(STRANGE) for _ in range(rng.randint(1, 9))) for _ in range(200)]
    for t in [*STRANGE, *mixed]:
        assert own(t.encode()).tolist() == [*plain.encode(t, add_special_tokens=False).ids, 1], t


@pytest.mark.parametrize("seed", range(6))
def test_fullest(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(6)}
    room = rng.randint(1, 90)
    best = max(sum(k * n for k, n in zip(counts, c, strict=True)) for c in itertools.product(*[range(n + 1) for n in counts.values()]) if sum(k * n for k, n in zip(counts, c, strict=True)) <= room)
    got = packing.fullest(counts, room)
    assert sum(k * n for k, n in got.items()) == best and all(n <= counts[k] for k, n in got.items())


def test_patterns():
    rng = random.Random(4)
    counts = {n: rng.randint(1, 30) for n in rng.sample(range(1, 101), 40)}
    bins = packing.patterns(dict(counts), 100)
    assert all(sum(k * m for k, m in b.items()) <= 100 for _, b in bins)
    assert {k: sum(t * b.get(k, 0) for t, b in bins) for k in counts} == counts
    # about as many bins as first-fit decreasing takes
    rooms = []
    for x in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        k = next((i for i, r in enumerate(rooms) if r >= x), None)
        if k is None:
            rooms.append(100 - x)
        else:
            rooms[k] -= x
    assert sum(t for t, _ in bins) <= 1.03 * len(rooms)


def check_packing(rows, got, capacity=4096):
    tok, want = Tokenizer.from_file(WORD), []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            cut = np.array(ids[k : k + capacity], "<u4")
            want.append((i, k // capacity, k, len(cut), zlib.crc32(cut.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(w[3] for w in want) // capacity)


def test_pack_documents(spark):
    got = packing.pack_documents(documents(spark), WORD).collect()
    n, least = check_packing([(i, t) for i, t, *_ in odd_rows()], got)
    assert n == least


def test_pack_driver_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n, least = check_packing([(r.doc_id, r.text) for r in docs.collect()], queries.op6_best_fit_packing(spark, sf).collect())
    assert n <= least + 1


def test_sequences(spark):
    """The ids of a sequence are those of its documents, in place."""
    docs = documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    made = packing.pack(packing.token_pieces(docs, WORD, keep_ids=True, capacity=64), capacity=64)
    rows = {r.sequence_id: r.ids for r in packing.sequences(made).collect()}
    for r in made.collect():
        assert rows[r.sequence_id][r.offset : r.offset + r.length] == r.ids


def test_encode_and_decode(spark):
    rows = [(i, t, None, None) for i, t in enumerate([*STRANGE, *[t for _, t, *_ in odd_rows()], " lead", "trail ", "a  b", "▁x", "\t\n"])]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = pieces.decode_documents(pieces.encode_documents(documents(spark, rows), PIECE), PIECE).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r.doc_id][1] or ""
        ids = sp.encode(text, num_threads=1)
        assert r.ids == ids and r.decoded == sp.decode(ids), text
        # spans tile the bytes in order
        assert len(r.ends) == len(ids) and r.ends == sorted(r.ends) and (not ids or r.ends[-1] == len(text.encode()))
        if ids:
            spans = [p.end for p in sp.encode(text, return_type="proto").pieces]
            whole = [k for k, i in enumerate(ids) if not sp.is_byte(i)]
            assert [r.ends[k] for k in whole] == [spans[k] for k in whole], text


def test_character_map():
    """A double-array trie made by hand, with longest matches and removals."""
    import struct

    units, texts = [0] * 512, b"x\0\0yz\0"

    def put(node_at, children, base):
        # offset bits for a base that differs from the node's place
        units[node_at] = units[node_at] & 0xFF | ((node_at ^ base) << 10) | (units[node_at] & 0x100)
        for byte in children:
            units[base ^ byte] = byte

    def leaf(node_at, base, value):
        units[node_at] |= 0x100
        units[base] = 0x80000000 | value

    put(0, [ord("a"), ord("b")], 1)
    a, b = 1 ^ ord("a"), 1 ^ ord("b")
    put(a, [ord("b")], 256)
    leaf(a, 256, 0)  # a -> x
    ab = 256 ^ ord("b")
    put(ab, [], 300)
    leaf(ab, 300, 3)  # ab -> yz
    put(b, [], 400)
    leaf(b, 400, 2)  # b -> nothing
    own = pieces.CharMap(struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + texts)
    assert own.longest(b"abc", 0) == (2, b"yz") and own.longest(b"aa", 0) == (1, b"x") and own.longest(b"b", 0) == (1, b"") and own.longest(b"c", 0) is None

    class Spec:
        precompiled_charsmap = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + texts
        add_dummy_prefix, remove_extra_whitespaces, escape_whitespaces = False, True, True

    out, at = pieces.Normaliser(Spec())(b"  ab  acb ")
    assert out == "yz▁xc".encode() and at.tolist() == [2, 2, 4, 4, 4, 6, 7, 9]


def test_malformed_bytes():
    """Each malformed part counts as U+FFFD; spans are places in the given bytes."""
    text = b"ab\xff c\xe2\x82 d\xf0"
    ids, ends = pieces.encoder(PIECE)(text)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert ids.tolist() == sp.encode(text.decode(errors="replace")) and ends.tolist() == sorted(ends.tolist()) and ends[-1] == len(text)
    assert pieces._places_before(text).tolist() == [0, 1, 2, 2, 2, 3, 4, 5, 5, 5, 7, 8, 9, 9, 9, 10]


def test_other_tokenizers_get_whole_texts():
    """The short way by words is for one form of model only."""
    assert packing.Words(WORD).by_words and not packing.Words(public_tokenizers.path("byte_bpe_50k.json")).by_words


def test_digests(spark, sf):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op9_sentencepiece(spark, sf).collect():
        ids = sp.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_empty(spark):
    empty = documents(spark, [])
    assert packing.pack_documents(empty, WORD).count() == 0
    assert pieces.decode_documents(pieces.encode_documents(empty, PIECE), PIECE).count() == 0


def test_decoded_beside_another_column(spark):
    """A column of the same name stays; the new one has another name."""
    df = spark.createDataFrame([(1, "a b", "old")], "doc_id long, text string, Decoded string")
    coded = pieces.encode_documents(df, queries.PIECE_MODEL).withColumn("Decoded", F.lit("old"))
    row = pieces.decode_documents(coded, queries.PIECE_MODEL).first()
    assert (row["Decoded"], row["_decoded"]) == ("old", "a b")
