"""Token alignment of two tokenizers: groups of tokens between common ends, and how often ids overlap in the corpus."""

from __future__ import annotations

import gc
import hashlib
import uuid
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import WHITE, Shipped, arrow_type, only, read_file, rows_of, sql_type
from vicinal.llm.flat_ids import Chunks, FlatEncoder, byte_level, distinct, joined, runs
from vicinal.session import Scratch

# Fixed value: what sentence-piece files write for a space.
SPACE = "▁"
#: Code points of a text beyond which it is cut over several tasks, and of each part.
LONG_CHARS = 1 << 20
#: Bytes of a long text in a fragment, and fragments that one step of the tree composes. Three steps
#: hold the longest text there can be, 2**31 bytes.
RANGE_BYTES, FAN_IN, STEPS = 1 << 18, 32, 3
#: Characters of texts in one block of results.
BLOCK_CHARS = 4 << 20
#: Distinct words that a Python worker remembers, with their groups and links, their bytes, and words learned in one step.
CHUNKS_HELD, BYTES_HELD, LEARNED_AT_ONCE = 250_000, 8 << 20, 1 << 14

NONE = np.zeros(0, np.int64)


class PieceEncoder:
    """Ids of words (a space, then what goes up to the next word) under a sentence-piece model, and bytes of its ids."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=model)
        size = self.library.get_piece_size()
        self.bytes: list[bytes] = [
            bytes([int(self.library.id_to_piece(i)[3:5], 16)])
            if self.library.is_byte(i)
            else self.library.id_to_piece(i).replace(SPACE, " ").encode()
            for i in range(size)
        ]
        self.bytes_of = np.array(list(map(len, self.bytes)), np.int64)
        probe = "a  ﬁ\tb İ１ "
        if self.library.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model normalises text")
        if any(SPACE in self.library.id_to_piece(i).lstrip(SPACE) for i in range(size)):
            raise ValueError("the model has pieces that span words")

    def ids_of(self, words: list[str]) -> list[list[int]]:
        # The library puts the space before; it makes nothing of an empty text.
        out = self.library.encode([w[1:] for w in words], num_threads=1) if words else []
        alone = [self.library.piece_to_id(SPACE)]
        return [ids if len(w) > 1 else alone for w, ids in zip(words, out, strict=True)]


def links(a_ends: np.ndarray, a_ids: np.ndarray, b_ends: np.ndarray, b_ids: np.ndarray):
    """Where each link ends, its pair of ids as one number, and whether both tokens end there.

    Two tokens overlap in one stretch of bytes that no token end parts, so that links and different ends are one to one.
    """
    ends = distinct(np.concatenate([a_ends, b_ends]))[0]
    a, b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
    return ends, (a_ids[a] << 32) | b_ids[b], (a_ends[a] == ends) & (b_ends[b] == ends)


def group_names(a_ends, a_ids, b_ends, b_ids, common: np.ndarray) -> list[bytes]:
    """`a1,a2|b1` for each group that ends at the places `common`."""
    a, b = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
    out, at_a, at_b = [], 0, 0
    a_cut, b_cut = np.searchsorted(a_ends, common, "right").tolist(), np.searchsorted(b_ends, common, "right").tolist()
    for to_a, to_b in zip(a_cut, b_cut, strict=True):
        out.append(f"{','.join(a[at_a:to_a])}|{','.join(b[at_b:to_b])}".encode())
        at_a, at_b = to_a, to_b
    return out


def _added(codes: tuple[np.ndarray, ...], counts: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Different codes and the sum of their counts."""
    found, place = np.unique(np.concatenate([NONE, *codes]), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, place, np.concatenate([NONE, *counts]))
    return found, total


@dataclass(frozen=True)
class Fragment:
    """What a range of bytes knows of its document's groups: tokens before its first common end, whole groups, and
    tokens after its last one. Fragments compose, and it does not matter in which order: `a + b` for neighbours,
    `Fragment()` for nothing. Without a common end all tokens are in the prefix.

    Tokens are (ends, ids) of one tokenizer, then of the other; a token belongs to the range it ends in.
    """

    cut: bool = False
    prefix: tuple[np.ndarray, ...] = (NONE, NONE, NONE, NONE)
    groups: bytes = b""
    n_groups: int = 0
    codes: np.ndarray = field(default_factory=lambda: NONE)
    counts: np.ndarray = field(default_factory=lambda: NONE)
    suffix: tuple[np.ndarray, ...] = (NONE, NONE, NONE, NONE)
    n_a: int = 0
    n_b: int = 0
    bad: bool = False

    @staticmethod
    def of(a_ends, a_ids, b_ends, b_ids, bad: bool = False) -> Fragment:
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        tokens = (a_ends, a_ids, b_ends, b_ids)
        made = Fragment(n_a=len(a_ends), n_b=len(b_ends), bad=bad)
        if not len(common):
            return replace(made, prefix=tokens)
        head, body, tail = _parted(tokens, common[0], common[-1])
        if len(body[0]):
            _, code, _ = links(*body)
            codes, counts = distinct(code)
            names = b";".join(group_names(*body, common[1:]))
        else:
            codes, counts, names = NONE, NONE, b""
        return replace(
            made, cut=True, prefix=head, suffix=tail, groups=names, n_groups=len(common) - 1, codes=codes, counts=counts
        )

    def _group(self, tokens) -> Fragment:
        """One whole group."""
        _, code, _ = links(*tokens)
        codes, counts = distinct(code)
        return Fragment(True, groups=group_names(*tokens, tokens[0][-1:])[0], n_groups=1, codes=codes, counts=counts)

    def __add__(self, other: Fragment) -> Fragment:
        joint = tuple(np.concatenate(x) for x in zip(self.suffix if self.cut else self.prefix, other.prefix, strict=True))
        told = {"n_a": self.n_a + other.n_a, "n_b": self.n_b + other.n_b, "bad": self.bad or other.bad}
        if not other.cut:
            return replace(self, **({"suffix": joint} if self.cut else {"prefix": joint}), **told)
        if not self.cut:
            return replace(other, prefix=joint, **told)
        middle = self._group(joint)
        codes, counts = _added((self.codes, middle.codes, other.codes), (self.counts, middle.counts, other.counts))
        return Fragment(
            True,
            self.prefix,
            b";".join(filter(None, [self.groups, middle.groups, other.groups])),
            self.n_groups + 1 + other.n_groups,
            codes,
            counts,
            other.suffix,
            **told,
        )

    def closed(self) -> Fragment | None:
        """The whole document from its fragment; None if its bytes are not those of both token rows."""
        if self.bad or not self.cut or len(self.suffix[0]) or len(self.suffix[2]):
            return None
        whole = Fragment(True) + self
        return replace(whole, prefix=Fragment.prefix)


def _parted(tokens, first, last):
    """Tokens that end up to `first`, up to `last`, and after it."""
    parts = ([], [], [])
    for ends, ids in (tokens[:2], tokens[2:]):
        x, y = np.searchsorted(ends, [first, last], "right")
        for part, piece in zip(parts, (slice(0, x), slice(x, y), slice(y, None)), strict=True):
            part += [ends[piece], ids[piece]]
    return tuple(map(tuple, parts))


class Aligner:
    """Groups and links of whole texts, made once for each distinct word."""

    def __init__(self, content: tuple[str, bytes]):
        self.a, self.b = FlatEncoder(content[0], plain=True), PieceEncoder(content[1])
        self.chunks = Chunks(self._learn, self._forget, only_spaces=True, held=CHUNKS_HELD, held_bytes=BYTES_HELD)
        self._forget()

    def _forget(self) -> None:
        self.names: list[bytes] = []
        # For each chunk: tokens of both, groups, whether bytes agree, where its links begin in `codes`, and how many.
        self.table = np.zeros((0, 6), np.int64)
        self.codes = NONE
        # Of the words being learned.
        self.new_rows: list[np.ndarray] = []
        self.new_codes: list[np.ndarray] = []

    def _learn(self, chunks: list[bytes]) -> None:
        for at in range(0, len(chunks), LEARNED_AT_ONCE):
            self._learn_some(chunks[at : at + LEARNED_AT_ONCE])
        self.table, self.codes = np.concatenate([self.table, *self.new_rows]), np.concatenate([self.codes, *self.new_codes])
        self.new_rows, self.new_codes = [], []

    def _learn_some(self, chunks: list[bytes]) -> None:
        """A word begins and ends where tokens of both do: its fragment is closed on both sides."""
        texts = [c.decode() for c in chunks]
        b_lists = self.b.ids_of(texts)
        piece = self.b.bytes
        good = np.array([b"".join([piece[i] for i in ids]) == c for c, ids in zip(chunks, b_lists, strict=True)], bool)
        kept = [c for c, ok in zip(chunks, good.tolist(), strict=True) if ok]
        a_ids, a_count = self.a.ids_of(kept) if kept else (NONE, NONE)
        a_ids = a_ids.astype(np.int64)
        b_lists = [ids for ids, ok in zip(b_lists, good.tolist(), strict=True) if ok]
        b_ids, b_count = np.array([i for ids in b_lists for i in ids], np.int64), np.array(list(map(len, b_lists)), np.int64)
        rows = np.zeros((len(chunks), 6), np.int64)
        rows[:, 3] = good
        names = [b""] * len(chunks)
        if kept:
            a_ends, b_ends = np.cumsum(self.a.bytes_of[a_ids]), np.cumsum(self.b.bytes_of[b_ids])
            chunk_ends = np.cumsum([len(c) for c in kept])
            ends, code, both = links(a_ends, a_ids, b_ends, b_ids)
            upto = np.searchsorted(ends, chunk_ends, "right")
            told = np.append(0, np.cumsum(both))
            group_upto = told[upto]
            n_links = np.diff(upto, prepend=0)
            rows[good, 0], rows[good, 1], rows[good, 2] = a_count, b_count, np.diff(group_upto, prepend=0)
            held = len(self.codes) + sum(map(len, self.new_codes))
            rows[good, 4], rows[good, 5] = held + upto - n_links, n_links
            self.new_codes.append(code)
            each = group_names(a_ends, a_ids, b_ends, b_ids, ends[both])
            begin = 0
            for i, end in zip(np.flatnonzero(good).tolist(), group_upto.tolist(), strict=True):
                names[i] = b";".join(each[begin:end])
                begin = end
        self.names += names
        self.new_rows.append(rows)

    def full(self) -> bool:
        """Whether numbers of chunks will begin anew."""
        return self.chunks.full()


class Block:
    """Texts of one block: what is known of each, and their chunks, whose links wait for counts over the corpus."""

    def __init__(self):
        self.ids, self.rows, self.names, self.numbers, self.ends = [], [], [], [], [0]
        self.size = 0

    def add(self, aligner: Aligner, ids: list, texts: list[str], digest: bool) -> None:
        number, upto = aligner.chunks.numbers(*joined([" " + t if t else "" for t in texts]))
        begin = 0
        for i, text, end in zip(ids, texts, upto.tolist(), strict=True):
            mine = number[begin:end]
            begin = end
            told = aligner.table[mine]
            if not told[:, 3].all():
                mine = mine[:0]
                told = told[:0]
            n_a, n_b, n_groups = told[:, :3].sum(axis=0).tolist()
            name = b";".join([aligner.names[k] for k in mine.tolist()])
            self.ids.append(i)
            # Every end is a link, common ends count once.
            self.rows.append((n_a, n_b, n_groups, n_a + n_b - n_groups))
            self.names.append(_told(name, digest))
            self.numbers.append(mine)
            self.ends.append(self.ends[-1] + len(mine))
            self.size += len(text)

    def row(self, block: str, aligner: Aligner, kind) -> pa.RecordBatch:
        number = np.concatenate([NONE, *self.numbers])
        used, times = distinct(number)
        begin, count = aligner.table[used, 4], aligner.table[used, 5]
        code = aligner.codes[runs(begin, count)]
        codes, place = np.unique(code, return_inverse=True)
        n = np.bincount(place, np.repeat(times, count), len(codes)).astype(np.int64)
        return _block_row(
            block, self.ids, self.rows, self.names, np.searchsorted(used, number), self.ends[1:], place, NONE, np.cumsum(count), codes, n, kind
        )


def _told(name: bytes, digest: bool) -> str:
    return (hashlib.sha256(name).hexdigest() if name else "") if digest else name.decode()


BLOCK_COLUMNS = (
    "block string, ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "names array<string>, doc_chunks binary, doc_ends binary, chunk_pairs binary, chunk_times binary, chunk_ends binary, "
    "pairs binary, pair_n binary"
)


def _block_row(block, ids, rows, names, doc_chunks, doc_ends, chunk_pairs, chunk_times, chunk_ends, pairs, pair_n, kind) -> pa.RecordBatch:
    numbers = [pa.array([list(c)], pa.list_(pa.int64())) for c in zip(*rows, strict=True)] or [pa.array([[]], pa.list_(pa.int64()))] * 4
    raw = [
        np.asarray(doc_chunks, "<i4"),
        np.asarray(doc_ends, "<i8"),
        np.asarray(chunk_pairs, "<i4"),
        np.asarray(chunk_times, "<i8"),
        np.asarray(chunk_ends, "<i8"),
        np.asarray(pairs, "<i8"),
        np.asarray(pair_n, "<i8"),
    ]
    columns = [pa.array([block]), pa.array([ids], pa.list_(kind)), *numbers, pa.array([names], pa.list_(pa.string()))]
    columns += [pa.array([x.tobytes()], pa.binary()) for x in raw]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCK_COLUMNS.split(", ")])


def _short_blocks(source: DataFrame, shipped: Shipped, digest: bool) -> DataFrame:
    kind = arrow_type(source, "_id")

    def run(batches):
        gc.disable()
        aligner = shipped.made(Aligner)
        block, made, held, size = Block(), 0, [], 0
        label = TaskContext.get().partitionId()
        for item in rows_of(batches, "_id", "_text"):
            held.append(item)
            size += len(item[1] or "")
            if size < LONG_CHARS:
                continue
            if block.ids and (aligner.full() or block.size >= BLOCK_CHARS):
                yield block.row(f"{label}-{made}", aligner, kind)
                block, made = Block(), made + 1
            block.add(aligner, [i for i, _ in held], [t or "" for _, t in held], digest)
            held, size = [], 0
        if block.ids and aligner.full():
            yield block.row(f"{label}-{made}", aligner, kind)
            block, made = Block(), made + 1
        if held:
            block.add(aligner, [i for i, _ in held], [t or "" for _, t in held], digest)
        if block.ids:
            yield block.row(f"{label}-{made}", aligner, kind)

    return source.mapInArrow(run, BLOCK_COLUMNS.format(kind=sql_type(source, "_id")))


def _safe_parts(text: str, after: frozenset, at_white: frozenset, size: int):
    """(byte offset, part) of a text cut every `size` characters or later, before a character of `at_white` that follows one
    outside `after`."""
    begin, offset = 0, 0
    while begin < len(text):
        end = begin + size
        while end < len(text) and not (text[end] in at_white and text[end - 1] not in after):
            end += 1
        part = text[begin:end]
        yield offset, part
        begin, offset = end, offset + len(part.encode())


def _long_blocks(source: DataFrame, shipped: Shipped, digest: bool, scratch: Scratch) -> DataFrame:
    """Long texts, over many tasks: parts encoded by themselves, tokens dealt by ranges of bytes, fragments composed in a tree."""
    id_type, kind = sql_type(source, "_id"), arrow_type(source, "_id")
    white, space = frozenset(WHITE), frozenset(" ")
    ascii_white = frozenset(c for c in WHITE if c < "\x80")

    def cut(batches):
        for i, text in rows_of(batches, "_id", "_text"):
            # A key of the row; the table is written once, which makes it stay.
            key, text = uuid.uuid4().hex, " " + text
            for which, parts in enumerate((_safe_parts(text, white, ascii_white, LONG_CHARS), _safe_parts(text, space, space, LONG_CHARS))):
                for offset, part in parts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key]), pa.array([i], kind), pa.array([which], pa.int32()), pa.array([offset]), pa.array([part])],
                        ["key", "_id", "which", "offset", "part"],
                    )

    cuts = source.mapInArrow(cut, f"key string, _id {id_type}, which int, offset long, part string")
    parts = scratch.save(cuts, "parts", large_rows=True)

    def encode(batches):
        gc.disable()
        aligner = shipped.made(Aligner)
        for key, which, offset, part in rows_of(batches, "key", "which", "offset", "part"):
            bad = False
            if which:
                ids = np.array(aligner.b.ids_of([part])[0], np.int64)
                bad = b"".join([aligner.b.bytes[i] for i in ids.tolist()]) != part.encode()
                ends = offset + np.cumsum(aligner.b.bytes_of[ids])
            else:
                ids = aligner.a.encode([part])[0].astype(np.int64)
                ends = offset + np.cumsum(aligner.a.bytes_of[ids])
            ranges = (ends - 1) // RANGE_BYTES
            for at in np.unique(ranges).tolist() if len(ids) else [offset // RANGE_BYTES]:
                mine = ranges == at
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key]), pa.array([at]), pa.array([which], pa.int32()), pa.array([bad])]
                    + [pa.array([x[mine].astype("<i8").tobytes()], pa.binary()) for x in (ends, ids)],
                    ["key", "at", "which", "bad", "ends", "ids"],
                )

    spread = parts.select("key", "which", "offset", "part").repartition(F.col("key"), F.col("which"), F.col("offset"))
    tokens = spread.mapInArrow(encode, "key string, at long, which int, bad boolean, ends binary, ids binary")

    def fragment(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: int.from_bytes(r["ends"][:8], "little"))
        sides = []
        for which in (0, 1):
            for column in ("ends", "ids"):
                raw = [np.frombuffer(r[column], "<i8") for r in rows if r["which"] == which]
                sides.append(np.concatenate([NONE, *raw]))
        return _fragment_row(rows[0]["key"], rows[0]["at"], Fragment.of(*sides, bad=any(r["bad"] for r in rows)))

    def compose(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["at"])
        whole = [_fragment_of(r) for r in rows]
        # Neighbours two by two, so that no byte is copied more than a few times.
        while len(whole) > 1:
            whole = [a + b for a, b in zip(whole[::2], whole[1::2])] + whole[len(whole) // 2 * 2 :]
        return _fragment_row(rows[0]["key"], rows[0]["at"] // FAN_IN, whole[0])

    pieces = tokens.groupBy("key", "at").applyInArrow(fragment, FRAGMENT_COLUMNS)
    for _ in range(STEPS):
        pieces = (
            pieces.withColumn("_to", F.expr(f"at div {FAN_IN}")).groupBy("key", "_to").applyInArrow(_without_last(compose), FRAGMENT_COLUMNS)
        )
    names = parts.where("which = 0 AND offset = 0").select(F.col("key").alias("_key"), "_id")

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                whole = _fragment_of(row).closed() or Fragment()
                n_a, n_b = (whole.n_a, whole.n_b) if whole.cut else (0, 0)
                codes = whole.codes
                yield _block_row(
                    f"long-{row['key']}",
                    [row["_id"]],
                    [(n_a, n_b, whole.n_groups, n_a + n_b - whole.n_groups)],
                    [_told(whole.groups, digest)],
                    [0] if len(codes) else NONE,
                    [int(len(codes) > 0)],
                    np.arange(len(codes)),
                    whole.counts,
                    [len(codes)] if len(codes) else NONE,
                    codes,
                    whole.counts,
                    kind,
                )

    ready = pieces.join(names, pieces["key"] == names["_key"]).drop("_key", "at")
    return ready.mapInArrow(finish, BLOCK_COLUMNS.format(kind=id_type))


def _without_last(compose):
    return lambda table: compose(table.drop_columns(["_to"]))


FRAGMENT_COLUMNS = (
    "key string, at long, cut boolean, p0 binary, p1 binary, p2 binary, p3 binary, groups binary, n_groups long, codes binary, "
    "counts binary, s0 binary, s1 binary, s2 binary, s3 binary, n_a long, n_b long, bad boolean"
)


def _fragment_row(key: str, at: int, f: Fragment) -> pa.Table:
    raw = lambda x: pa.array([np.asarray(x, "<i8").tobytes()], pa.binary())
    columns = [pa.array([key]), pa.array([at], pa.int64()), pa.array([f.cut]), *map(raw, f.prefix), pa.array([f.groups], pa.binary())]
    columns += [pa.array([f.n_groups], pa.int64()), raw(f.codes), raw(f.counts), *map(raw, f.suffix)]
    columns += [pa.array([f.n_a], pa.int64()), pa.array([f.n_b], pa.int64()), pa.array([f.bad])]
    return pa.Table.from_arrays(columns, [c.split()[0] for c in FRAGMENT_COLUMNS.split(", ")])


def _fragment_of(row: dict) -> Fragment:
    numbers = lambda name: np.frombuffer(row[name], "<i8")
    return Fragment(
        row["cut"],
        tuple(numbers(f"p{k}") for k in range(4)),
        row["groups"],
        row["n_groups"],
        numbers("codes"),
        numbers("counts"),
        tuple(numbers(f"s{k}") for k in range(4)),
        row["n_a"],
        row["n_b"],
        row["bad"],
    )


def align_tokenizers(
    df: DataFrame, a_path: str, b_path: str, digest: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Align the tokens of a byte-level tokenizer (A, of a space and the text) and a sentence-piece model (B, of the text).

    One row a document: `id_col`, `n_a`, `n_b`, `n_groups` (stretches between places where tokens of both end), `n_links`
    (pairs of an A and a B token whose bytes overlap), `n_best` (links whose pair of ids is the commonest of its B id in the
    corpus, ties included), `count_sum` (over links, how many links of the corpus have the same pair of ids), and `groups`:
    `a1,a2|b1;a3|b2,b3`, or with `digest` `groups_sha256`.

    Words are aligned once a worker remembers them; texts beyond LONG_CHARS are cut over tasks, and fragments of byte
    ranges composed in a tree. Counts of pairs are summed over all links. A null or empty text, or one whose
    bytes the tokens do not give back, has zeros and an empty string. Null and repeated ids: each row is a document of
    its own. An empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    content = read_file(a_path).decode()
    if not byte_level(content):
        raise ValueError("the first tokenizer must be byte-level, without normaliser")
    shipped = Shipped(spark, (content, read_file(b_path)))
    scratch = Scratch(spark)
    source = only(df, _id=id_col, _text=text_col)
    is_long = F.coalesce(F.char_length("_text") > LONG_CHARS, F.lit(False))
    made = _short_blocks(source.where(~is_long), shipped, digest).unionByName(
        _long_blocks(source.where(is_long), shipped, digest, scratch)
    )
    blocks = scratch.save(made, "blocks", large_rows=True)

    def tell(batches):
        for batch in batches:
            for row in batch.to_pylist():
                code, n = np.frombuffer(row["pairs"], "<i8"), np.frombuffer(row["pair_n"], "<i8")
                for at in range(0, len(code), 65_536):
                    part = slice(at, at + 65_536)
                    size = len(code[part])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["block"]] * size, pa.string()),
                            pa.array(np.arange(at, at + size, dtype=np.int32)),
                            pa.array((code[part] >> 32).astype(np.int32)),
                            pa.array((code[part] & 0xFFFFFFFF).astype(np.int32)),
                            pa.array(n[part]),
                        ],
                        ["block", "at", "a", "b", "n"],
                    )

    pairs = blocks.select("block", "pairs", "pair_n").mapInArrow(tell, "block string, at int, a int, b int, n long")
    counted = scratch.save(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "counts")
    # One row for each id of B, whose vocabulary bounds it.
    most = counted.groupBy("b").agg(F.max("count").alias("_most"))
    best = counted.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("_most")).alias("best"))
    looked = pairs.select("block", "at", "a", "b").join(best, ["a", "b"]).select("block", "at", "count", "best")
    name = "groups_sha256" if digest else "groups"
    id_type, kind = sql_type(source, "_id"), arrow_type(source, "_id")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            raw = {c: np.frombuffer(row[c], t) for c, t in _RAW.items()}
            value = np.zeros((len(raw["pairs"]), 2), np.int64)
            at = right.column("at").to_numpy()
            value[at, 0], value[at, 1] = right.column("best").to_numpy(zero_copy_only=False), right.column("count").to_numpy()
            each = value[raw["chunk_pairs"]]
            if len(raw["chunk_times"]):
                each = each * raw["chunk_times"][:, None]
            by_chunk = np.diff(_upto(each)[raw["chunk_ends"]], axis=0, prepend=0)
            by_doc = np.diff(_upto(by_chunk[raw["doc_chunks"]])[raw["doc_ends"]], axis=0, prepend=0)
            columns = [pa.array(row["ids"], kind)] + [pa.array(row[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
            columns += [pa.array(by_doc[:, 0]), pa.array(by_doc[:, 1]), pa.array(row["names"], pa.string())]
            out.append(pa.Table.from_arrays(columns, [id_col, *COUNTS, name]))
        return pa.concat_tables(out)

    schema = f"`{id_col}` {id_type}, " + ", ".join(f"{c} long" for c in COUNTS) + f", {name} string"
    return blocks.groupBy("block").cogroup(looked.groupBy("block")).applyInArrow(finish, schema)


COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_RAW = {"doc_chunks": "<i4", "doc_ends": "<i8", "chunk_pairs": "<i4", "chunk_times": "<i8", "chunk_ends": "<i8", "pairs": "<i8"}


def _upto(rows: np.ndarray) -> np.ndarray:
    """Sums of all rows before each, and of all."""
    return np.concatenate([np.zeros((1, rows.shape[1]), np.int64), np.cumsum(rows, axis=0)])
