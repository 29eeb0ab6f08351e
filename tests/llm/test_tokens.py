import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyloom.llm import bpe, packing

PATH = bpe.default_vocabulary()
LIBRARY = Tokenizer.from_file(PATH)
VOCABULARY = bpe.vocabulary(PATH)
OURS = bpe.Encoder(VOCABULARY)
FLAT = bpe.Encoder(VOCABULARY, library=True)
ODD = ["", " ", "<|endoftext|> a<|startoftext|>b", "It's WE'LL don't 'sfoo", "Σίσυφος ΣΑΣ İ é", "a\x1cb\x1fc\u2003d\xa0e", "１２3 ²½ 漢字 😀👍🏽 a_b--c", "<|endoftext", "<|EndOfText|> a<|endoftext|>", "<|ENDOFTEXT|>", "x" * 3000, "aaaa" * 200, "\ufeffzero\u200bwidth", "a\x00b \x7f"]


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    ids = OURS.encode([text])[0]
    assert ids == library(text)
    assert OURS.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeinorstéßñÀ'’.,!0179 \n\t-_漢Σ"), max_size=60))
def test_any_text(text):
    assert OURS.encode([text])[0] == library(text)
    assert flat([text, None, text]) == [[*library(text), 2], [2], [*library(text), 2]]


def flat(texts, encoder=FLAT):
    ids, stops = encoder.flat(texts, 2)
    return [x.tolist() for x in np.split(ids, stops[:-1])]


def test_flat_encoding_of_odd_texts():
    assert flat([*ODD, *ODD]) == [[*library(t), 2] for t in [*ODD, *ODD]]
    assert flat(["aCbX c", "a\x1cb<|endoftext|>\x1d!"]) == [[*library(t), 2] for t in ["aCbX c", "a\x1cb<|endoftext|>\x1d!"]]


def test_white_space_and_unassigned_signs():
    signs = [f"a{chr(c)}B" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (chr(c).isspace() or c % 97 == 0 or 0x500 < c < 0x600)]
    assert flat(signs) == [[*library(t), 2] for t in signs]
    assert OURS.encode(signs) == [library(t) for t in signs]


def test_flat_memo_overflow_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 20)
    small = bpe.Encoder(VOCABULARY, library=True)
    for i in range(5):
        texts = [f"word{i} other{i % 7}, thing{k}. ünder" for k in range(30)]
        assert flat(texts, small) == [[*library(t), 2] for t in texts]


def test_memo_overflow_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 20)
    small = bpe.Encoder(VOCABULARY)
    texts = [f"word{i} other{i % 7} thing{i}." for i in range(200)]
    got = [b"".join(memo[c] for c in chunks) for chunks, memo in small.batches(texts, most=10)]
    assert [np.frombuffer(x, bpe.id_type(PATH)).tolist() for x in got] == [library(t) for t in texts]


def test_digests(docs, rows):
    got = sorted(map(tuple, bpe.digests(docs, PATH).collect()), key=str)
    want = []
    for r in rows:
        ids = library(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_encode_and_decode_keep_other_columns(docs, none):
    out = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "block", "n", "score", "ids", "decoded"]
    assert all(r["decoded"] == LIBRARY.decode(r["ids"], skip_special_tokens=False) for r in out.limit(20).collect())
    assert bpe.encode(none, PATH).count() == 0


def check_pieces(pieces, lengths, room):
    tokens, sequences = defaultdict(list), defaultdict(list)
    for d, start, length, seq, at in pieces:
        assert length > 0
        tokens[d].append((start, length))
        sequences[seq].append((at, length))
    for d, n in enumerate(lengths):
        at = 0
        for start, length in sorted(tokens[d]):
            assert start == at
            at += length
        assert at == n
    padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
        padded += at if at & (at - 1) == 0 else room
    return padded


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1500), max_size=80), st.floats(0, 1))
def test_packing_covers_all_tokens(lengths, share):
    demand = defaultdict(int)
    for n in lengths:
        demand[n % 256 // 16] += 1
    pieces = packing.pack_lengths(lengths, packing.solve(demand, 16), share, 256)
    assert check_pieces(pieces, lengths, 256) == sum(lengths)


def test_column_generation_reaches_the_bound():
    patterns = packing.solve({6: 30, 5: 40, 3: 20, 2: 50}, 12)
    assert sum(x for x, _ in patterns) == pytest.approx((6 * 30 + 5 * 40 + 3 * 20 + 2 * 50) / 12, rel=0.05)
    for _, p in patterns:
        assert sum(k * v for k, v in p.items()) <= 12
    assert packing.solve({0: 5}, 12) == []


def test_pack(docs, rows, none):
    got = packing.pack(docs, PATH, length=256, end=2).collect()
    total = sum(len(library(r[1] or "")) + 1 for r in rows)
    assert sum(r["length"] for r in got) == total
    by_length = defaultdict(list)
    for r in rows:
        by_length[r[0], len(library(r[1] or "")) + 1].append(np.array([*library(r[1] or ""), 2], "<u4"))
    sequences = defaultdict(list)
    for r in got:
        options = by_length[r["doc_id"], r["doc_tokens"]]
        assert any(zlib.crc32(o[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for o in options)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        padded += at if at & (at - 1) == 0 else 256
    assert padded <= 1.02 * total
    assert packing.pack(none, PATH).count() == 0
