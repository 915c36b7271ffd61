"""Packed sequences against the library, and the curve they follow."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vicinal.llm.flat_ids import FlatEncoder
from vicinal.llm.packing import CurveKeys, along_curve, hilbert, pack_sequences, sizes_of_rest
from vicinal.llm.queries import op12_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check(pieces, want):
    """`pieces` hold every document of `want` (id to ids, end id included) once, in whole sequences."""
    got, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        got[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    assert set(got) == set(want)
    for i, ids in want.items():
        at = 0
        for p in sorted(got[i], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        # Nothing is padded: each is full, or a power of two.
        assert at <= 2048 and at & (at - 1) == 0


def test_all_documents_are_packed(spark, documents, library):
    rows = [(r.doc_id, r.text or "") for r in documents.select("doc_id", "text").collect()]
    want = {i: e.ids + [1] for (i, _), e in zip(rows, library.encode_batch([t for _, t in rows], add_special_tokens=False))}
    check(op12_packing(spark, SF_DIR).collect(), want)


def test_awkward_rows(awkward, nothing, library):
    pieces = pack_sequences(awkward, PATH, end_id=1).collect()
    rows = [(r.doc_id, r.text or "") for r in awkward.collect()]
    want = sorted((str(i), tuple(library.encode(t, add_special_tokens=False).ids + [1])) for i, t in rows)
    # Rows with one id are documents of their own: walk the sequences in order and part them where a piece starts at 0.
    got, left = [], defaultdict(list)
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        left[p.doc_id].append(p)
    for i, parts in left.items():
        parts.sort(key=lambda p: (p.sequence_id, p.offset))
        ids = [x for p in parts for x in p.ids]
        while ids:
            n = ids.index(1) + 1
            got.append((str(i), tuple(ids[:n])))
            ids = ids[n:]
    assert sorted(got) == want
    assert pack_sequences(nothing, PATH, end_id=1).count() == 0


def test_a_hot_text_is_spread(spark, library):
    """A third of all rows with one text: more tasks than one have them."""
    rows = [(i, "one and the same text" if i % 3 == 0 else f"text {i * 7919} number {i}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    pieces = pack_sequences(frame, PATH, end_id=1, digest=True).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    check(pieces, {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in rows})
    assert len({p.sequence_id >> 36 for p in pieces if p.doc_id % 3 == 0}) > 1


def test_curve_visits_neighbours():
    bits, side = 3, 8
    grid = np.array([(a, b, c) for a in range(side) for b in range(side) for c in range(side)])
    walk = grid[np.argsort(hilbert(grid, bits))]
    assert sorted(hilbert(grid, bits).tolist()) == list(range(side**3))
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_documents_that_are_alike_lie_together(documents):
    """Along the curve the next document is far likelier of the same language than by chance."""
    rows = along_curve(documents.where("length(text) > 200")).collect()
    lang = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    walk = [lang[r._id] for r in sorted(rows, key=lambda r: r._key)]
    alike = np.mean([a == b for a, b in zip(walk, walk[1:])])
    chance = sum((walk.count(k) / len(walk)) ** 2 for k in set(walk))
    assert alike > 1.5 * chance
    empty, one, same = CurveKeys()(["", "one text", "one text"])
    assert one == same != empty


def test_sizes_of_rest():
    assert sizes_of_rest(0) == [] and sizes_of_rest(2047) == [1 << b for b in range(10, -1, -1)] and sizes_of_rest(8) == [8]


def test_flat_encoder_equals_the_library(library):
    rng = np.random.default_rng(3)
    signs = ["a", "é", "à", " ", "\n", "\t", "\xa0", " ", "　", "1", ".", "<|endoftext|>", "'s", "\x1c", "\x85", " ", "​", "﻿", "🙂"]
    texts = ["", " ", "\n\n", "x   y  z", "　 a", "\x85 b", "\x00 a \x1c b"] + [
        "".join(rng.choice(signs, rng.integers(1, 40))) for _ in range(2000)
    ]
    for plain in (False, True):
        library.encode_special_tokens = plain
        encoder = FlatEncoder(open(PATH).read(), plain)
        encoder.chunks.held = 500  # Forgets all the time.
        for at in range(0, len(texts), 100):
            ids, ends = encoder.encode(texts[at : at + 100])
            want = [e.ids for e in library.encode_batch(texts[at : at + 100], add_special_tokens=False)]
            assert [part.tolist() for part in np.split(ids, ends[:-1])] == want
    library.encode_special_tokens = False
