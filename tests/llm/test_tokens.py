"""Token operators against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vicinal.llm import common
from vicinal.llm.byte_bpe import Encoder, decode_ids, encode_decode, encoding_digest, read_ranks
from vicinal.llm.merges import MergeTable, merge_one
from vicinal.llm.token_counts import PieceCounter, token_counts
from vicinal.llm.token_files import ESCAPED, LibraryEncoder, pack, read_digests, read_tokens, unpack, write_tokens
from vicinal.session import Scratch

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
PATTERN = public_tokenizers.PATTERN
LETTERS = "aab  \n\t'sé中x!!1 　\x1c\x85 the ing🙂▁▁\x00\xa0"


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(1)
    made = ["".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    return made + ["a" * 3000, " " * 900 + "x", " \n" * 50, "aaab" * 300, "", " ", "▁", " ▁", "<s> </s>", "x <|endoftext|>y"]


@pytest.fixture(params=[None, 40])
def held(request, monkeypatch):
    """All texts at once, or in small parts with a small memory."""
    if request.param:
        monkeypatch.setattr(common, "SEGMENT_CHARS", request.param)
        monkeypatch.setattr(common, "BLOCK_CHARS", 5 * request.param)
        monkeypatch.setattr(common, "CHUNKS_HELD", 50)


def test_replay(texts, plain, held):
    encoder = Encoder(read_ranks(RANKS), PATTERN)
    ids = [np.frombuffer(x, "<i4") for x in encoder.encode(texts)]
    assert [x.tolist() for x in ids] == [plain.encode_ordinary(t) for t in texts]
    assert [encoder.decode(x) for x in ids] == [t.encode() for t in texts]


def test_replay_where_a_merge_makes_an_earlier_one_possible():
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"cd", b"ab", b"aaa", b"aa"]
    ranks = {t: i for i, t in enumerate(tokens)}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    draw = random.Random(2)
    words = ["".join(draw.choice("abcd") for _ in range(draw.randint(1, 12))) for _ in range(5000)] + ["a" * n for n in range(1, 12)]
    assert [np.frombuffer(x, "<i4").tolist() for x in Encoder(ranks, PATTERN).encode(words)] == [own.encode_ordinary(w) for w in words]


def test_merge_one_takes_the_lowest_rank_then_the_leftmost():
    table = MergeTable([1, 1, 9], [1, 2, 1], [9, 8, 7], [3, 1, 2])
    assert merge_one([1, 1, 1, 2], table) == [9, 8]
    assert merge_one([1, 1, 1], table) == [7]
    assert merge_one([], table) == [] and merge_one([5], table) == [5]


def test_library_words(texts, held):
    library = Tokenizer.from_file(JSON)
    got = LibraryEncoder(open(JSON).read()).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts(texts, held):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert PieceCounter(open(MODEL, "rb").read()).count(texts) == [len(x) for x in library.encode(texts, num_threads=1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_packing_round_trip(values):
    ids = np.array(values, np.uint64)
    words, escapes, marks = pack(ids)
    assert (unpack(words, escapes, marks, len(ids)) == ids).all()
    assert len(escapes) == (ids >= ESCAPED).sum()


def test_packing_is_dense():
    assert len(pack(np.zeros(1024, np.uint64))[0]) == 18  # 60 ids a word
    assert len(pack(np.full(1024, 50_000, np.uint64))[0]) == 342  # three


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_encoding_query(awkward, nothing, plain):
    encoded = encode_decode(awkward, RANKS, PATTERN)
    got = sorted((tuple(r) for r in encoding_digest(encoded).collect()), key=repr)
    want = []
    for r in awkward.collect():
        ids = plain.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    assert got == sorted(want, key=repr)
    assert encode_decode(nothing, RANKS, PATTERN).count() == 0
    again = decode_ids(encoded.withColumnRenamed("decoded", "d"), RANKS)
    assert again.where("decoded <> d").count() == 0


def test_count_query(awkward, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted((tuple(r) for r in token_counts(awkward, MODEL).collect()), key=repr)
    sizes = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in awkward.collect()]
    assert got == sorted(((*s, s[2] > 4096) for s in sizes), key=repr)
    assert token_counts(nothing, MODEL).count() == 0


def test_file_query(spark, awkward, nothing):
    scratch, library = Scratch(spark), Tokenizer.from_file(JSON)
    path = scratch.new_path("tokens")
    write_tokens(awkward, path, JSON, 2)
    rows = sorted(((r.doc_id, r.text or "") for r in awkward.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, {}
    for doc_id, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        want.setdefault(doc_id, []).append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = read_digests(spark, path).collect()
    assert {r.doc_id for r in got} == set(want) and len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:  # rows without an id lie in any order
            assert (r.start, r.n_tokens, r.ids_crc32) in want[r.doc_id]
    assert sum(r.n_tokens for r in got) == start and len({r.start for r in got}) == len(got)
    for r in read_tokens(spark, path).collect():
        assert r.n_tokens == len(r.ids) and r.ids[-1] == 2
    empty = scratch.new_path("tokens")
    write_tokens(nothing, empty, JSON, 2)
    assert read_digests(spark, empty).count() == 0
