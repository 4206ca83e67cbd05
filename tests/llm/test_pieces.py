"""Unigram encoding, decoding and counting against the public library, fed with the same pieces and scores."""

import random
import struct

import pytest

from hearthpanel.llm import model_file, token_counts, unigram
from hearthpanel.llm.queries import MODEL

spm = pytest.importorskip("sentencepiece")


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _model(pieces, scores, types, fallback):
    """A unigram model file with these pieces and identity normalisation."""
    body = b""
    for piece, score, kind in zip(pieces, scores, types):
        text = piece.encode()
        entry = b"\x0a" + _varint(len(text)) + text + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])
        body += b"\x0a" + _varint(len(entry)) + entry
    trainer = b"\x18\x01\x98\x02" + bytes([fallback])
    return body + b"\x12" + _varint(len(trainer)) + trainer + b"\x1a\x04\x18\x01\x20\x00"


@pytest.fixture(scope="module")
def vocabulary():
    return model_file.read_vocabulary(MODEL)


@pytest.fixture(scope="module")
def library(vocabulary):
    return spm.SentencePieceProcessor(model_proto=_model(vocabulary.pieces, vocabulary.scores, vocabulary.types, 1))


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(4)
    letters = list("ab  \n\t▁é🙂<0x0A>梦́the ing ") + ["the", "tion", " of ", "\x00", "�"]
    return ["", " ", "  a", "a ", "Hello  world, été\n"] + ["".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(1500)]


def test_equal_to_the_library(vocabulary, library, samples):
    codec, counter = unigram.Codec(vocabulary), token_counts.PieceCounter(vocabulary)
    for text in samples:
        ids = library.encode(text)
        assert list(codec.encode(text)) == ids, text
        assert codec.decode(ids) == library.decode(ids)
        count, score = counter.text(text)
        assert count == len(ids)
    rng = random.Random(6)
    for _ in range(500):  # any ids, broken UTF-8 among them
        ids = rng.choices(range(600), k=rng.randint(0, 9))
        assert codec.decode(ids) == library.decode(ids)


def test_ties_unknown_runs_and_own_pieces():
    """Without byte fallback; equal scores, a user-defined piece and characters outside the vocabulary."""
    pieces = ["<unk>", "<s>", "</s>", "▁", "a", "b", "ab", "aab", "ba", "aa", "▁a", "<x>", "c"]
    scores = [0, 0, 0, -1.0, -1.0, -1.0, -2.0, -3.0, -2.0, -2.0, -2.0, -9.0, -1.5]
    types = [2, 3, 3, 1, 1, 1, 1, 1, 1, 1, 1, 4, 1]
    library = spm.SentencePieceProcessor(model_proto=_model(pieces, scores, types, 0))
    vocabulary = model_file.Vocabulary(pieces, [float(s) for s in scores], types)
    codec, counter = unigram.Codec(vocabulary), token_counts.PieceCounter(vocabulary)
    rng = random.Random(8)
    for _ in range(1500):
        text = "".join(rng.choices(["a", "b", "c", " ", "zz", "\n", "<x>", "é"], k=rng.randint(0, 14)))
        ids = library.encode(text)
        assert list(codec.encode(text)) == ids, (text, ids, codec.encode(text))
        assert counter.text(text)[0] == len(ids), text


def test_double_array_is_a_dictionary():
    rng = random.Random(1)
    keys = sorted({bytes(rng.choices(b"ab\x00\xff", k=rng.randint(1, 6))) for _ in range(300)})
    trie = unigram.DoubleArray([(k, i) for i, k in enumerate(keys)])
    place = {k: i for i, k in enumerate(keys)}
    for _ in range(500):
        data = bytes(rng.choices(b"ab\x00\xff", k=8))
        assert trie.prefixes(data) == [(n, place[data[:n]]) for n in range(1, 9) if data[:n] in place]
    assert unigram.DoubleArray([]).prefixes(b"abc") == []


def test_tables(spark, vocabulary, samples):
    rows = [(i, t, 0) for i, t in enumerate(samples[:60])] + [(7, None, 1), (None, "x y", 2), (7, "x y", 3), (8, "long text " * 20_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(2)
    coded = unigram.encode(docs, MODEL, decoded="decoded").collect()
    counts = token_counts.token_counts(docs, MODEL)
    assert len(coded) == counts.count() == len(rows)
    codec = unigram.Codec(vocabulary)
    for r in coded:
        assert r["_ids"] == (None if r.text is None else list(codec.encode(r.text)))
        assert r.n_pieces == len(codec.encode(r.text)) and r.round_trip == (None if r.text is None else r.decoded == r.text)
    assert sorted(r.n_pieces for r in coded) == sorted(r.n_pieces for r in counts.collect())
    again = unigram.decode(unigram.encode(docs.drop("ids"), MODEL), MODEL).filter("text is not null and not decoded <=> text")
    assert [r for r in again.collect() if "▁" not in r.text] == []
    assert unigram.encode(docs.limit(0), MODEL).count() == 0 == token_counts.token_counts(docs.limit(0), MODEL).count()
