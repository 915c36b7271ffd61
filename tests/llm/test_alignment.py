"""Alignment of two tokenizers against a plain count over all tokens."""

import hashlib
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vicinal import session
from vicinal.llm import alignment
from vicinal.llm.alignment import Fragment, align_tokenizers
from vicinal.llm.flat_ids import Chunks, joined
from vicinal.llm.queries import op13_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokens():
    """Text to ((bytes, id) of A, of B), or two empty lists where the bytes don't give the text back."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    byte_of = {chr(x): x for x in shown}
    byte_of |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def of(text):
        if not text:
            return [], []
        one = [(bytes(byte_of[c] for c in a.id_to_token(i)), i) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(piece(i), i) for i in b.encode(text)]
        whole = (" " + text).encode()
        if any(b"".join(x for x, _ in side) != whole for side in (one, two)):
            return [], []
        return one, two

    return of


def brute(rows, tokens):
    told, pair_count = [], Counter()
    for i, text in rows:
        sides = tokens(text)
        ranges = []
        for side in sides:
            at, spans = 0, []
            for raw, token in side:
                spans.append((at, at + len(raw), token))
                at += len(raw)
            ranges.append(spans)
        one, two = ranges
        common = sorted({e for _, e, _ in one} & {e for _, e, _ in two})
        groups, at = [], 0
        for end in common:
            part = [",".join(str(t) for s, e, t in side if s >= at and e <= end) for side in (one, two)]
            groups.append("|".join(part))
            at = end
        links, first = [], 0
        for s, e, t in one:
            while first < len(two) and two[first][1] <= s:
                first += 1
            k = first
            while k < len(two) and two[k][0] < e:
                links.append((t, two[k][2]))
                k += 1
        pair_count.update(links)
        told.append((i, len(one), len(two), len(groups), links, ";".join(groups)))
    most = defaultdict(int)
    for (_, b), n in pair_count.items():
        most[b] = max(most[b], n)
    return sorted(
        (str(i), na, nb, ng, len(ln), sum(pair_count[p] == most[p[1]] for p in ln), sum(pair_count[p] for p in ln), g)
        for i, na, nb, ng, ln, g in told
    )


def got(frame):
    return sorted(
        (str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r[-1]) for r in frame.collect()
    )


def digests(rows):
    return [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in rows]


def test_whole_table(spark, tokens):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text[:20_000] if r.text else r.text) for r in documents.collect()], tokens)
    short = documents.selectExpr("doc_id", "substring(text, 1, 20000) AS text")
    assert got(align_tokenizers(short, A, B)) == want
    assert got(align_tokenizers(short, A, B, digest=True)) == digests(want)
    rows = op13_alignment(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == documents.count()


def test_awkward_rows(awkward, nothing, tokens):
    assert got(align_tokenizers(awkward, A, B)) == brute([(r.doc_id, r.text) for r in awkward.collect()], tokens)
    assert align_tokenizers(nothing, A, B).count() == 0


ODD = ["a▁b", "<s> <unk> <|endoftext|> <0x41>", "x  y   z ", "  \n\n tab\t.", " ", "\n", "　 wide　", "na\xa0 b", "中文字 测试", "🙂 🙂🙂", "é" * 50]


def test_odd_texts(spark, tokens):
    rng = np.random.default_rng(2)
    signs = ["a", "é", " ", " ", "\n", "\xa0", "　", "1", "中", "🙂", "the", ".", "\t", "\x00"]
    rows = list(enumerate(ODD + ["".join(rng.choice(signs, rng.integers(1, 30))) for _ in range(400)]))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, tokens)
    assert got(align_tokenizers(frame, A, B)) == want
    assert next(w for w in want if w[0] == "0")[1:] == (0, 0, 0, 0, 0, 0, "")


def test_long_texts_go_over_many_tasks(spark, tokens, monkeypatch):
    """The same rows when every text over some characters is cut into parts and its fragments are composed in a tree."""
    rng = np.random.default_rng(4)
    signs = ["alpha ", "beta", "é", " ", "\n", "　", "1", "中文", "🙂", "the ", ". ", "x" * 40]
    rows = list(enumerate(["".join(rng.choice(signs, n)) for n in (5, 80, 400, 900)] + ODD * 2 + ["x" * 700, ODD[0] * 50, None, ""]))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(alignment, "LONG_CHARS", 30)
    monkeypatch.setattr(alignment, "RANGE_BYTES", 8)
    monkeypatch.setattr(alignment, "FAN_IN", 16)
    assert got(align_tokenizers(frame, A, B)) == brute(rows, tokens)


def pieces_of(tokens, text, size):
    one, two = tokens(text)
    sides = []
    for side in (one, two):
        sides += [np.cumsum([len(raw) for raw, _ in side]), np.array([i for _, i in side], np.int64)]
    made = []
    for at in range(int(sides[0][-1] - 1) // size + 1):
        part = []
        for ends, ids in (sides[:2], sides[2:]):
            mine = (ends - 1) // size == at
            part += [ends[mine], ids[mine]]
        made.append(Fragment.of(*part))
    return made


def same(a, b):
    plain = [a.cut, a.groups, a.n_groups, a.n_a, a.n_b, a.bad] == [b.cut, b.groups, b.n_groups, b.n_a, b.n_b, b.bad]
    arrays = zip([*a.prefix, *a.suffix, a.codes, a.counts], [*b.prefix, *b.suffix, b.codes, b.counts], strict=True)
    return plain and all(np.array_equal(x, y) for x, y in arrays)


def test_fragments_compose_in_any_order(tokens):
    text = "Unglaublich therefore, été; naïveté 中文 words xxxxxxxxxxxxx and more\nlines 12345 of it"
    for size in (1, 2, 3, 7, 20, 1000):
        made = pieces_of(tokens, text, size)
        left = reduce(lambda a, b: a + b, made, Fragment())
        right = reduce(lambda a, b: b + a, reversed(made), Fragment())
        rng = np.random.default_rng(size)
        some = list(made)
        while len(some) > 1:
            k = int(rng.integers(len(some) - 1))
            some[k : k + 2] = [some[k] + some[k + 1]]
        assert same(left, right) and same(left, some[0])
        assert same(Fragment() + left, left) and same(left + Fragment(), left)
        whole = left.closed()
        assert (("0", whole.n_a, whole.n_b, whole.n_groups), whole.groups.decode()) == (
            lambda w: (w[:4], w[-1])
        )(brute([(0, text)], tokens)[0])


def test_blocks_are_let_go_one_by_one(spark, tokens, monkeypatch):
    """Rows of megabytes neither wait for a hundred others in the writer nor come back together in the reader."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(alignment, "LONG_CHARS", 500)
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 500)
    monkeypatch.setitem(session.LARGE_ROWS, "parquet.block.size", "1024")
    kept, save = [], session.Scratch.save

    def remember(self, df, name, *args, **options):
        kept.append((name, save(self, df, name, *args, **options)))
        return kept[-1][1]

    monkeypatch.setattr(session.Scratch, "save", remember)
    assert got(align_tokenizers(frame, A, B)) == brute(rows, tokens)
    (blocks,) = [table for name, table in kept if name == "blocks"]
    files = [pq.ParquetFile(path.removeprefix("file:")) for path in blocks.inputFiles()]
    assert sum(f.metadata.num_rows for f in files) == sum(f.num_row_groups for f in files) > 3


def test_few_words_are_learned_and_held(spark, tokens, monkeypatch):
    rows = list(enumerate(ODD + [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]))
    monkeypatch.setattr(alignment, "LONG_CHARS", 200)
    monkeypatch.setattr(alignment, "BYTES_HELD", 300)
    monkeypatch.setattr(alignment, "LEARNED_AT_ONCE", 7)
    assert got(align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string"), A, B)) == brute(rows, tokens)


def test_words_are_forgotten_by_their_bytes():
    learned, forgotten = [], []
    chunks = Chunks(learned.append, lambda: forgotten.append(1), only_spaces=True, held_bytes=40)
    for i in range(6):
        chunks.numbers(*joined([" " + str(i) * 30]))
    assert len(forgotten) == 2 and len(chunks.known) == 2
