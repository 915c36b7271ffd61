"""Packing documents into sequences of a fixed size along a space-filling curve through their contents."""

from __future__ import annotations

import gc
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import BLOCK_CHARS, Shipped, arrow_type, blocks, only, read_file, rows_of, shuffle_width, sql_type
from vicinal.llm.flat_ids import ASCII_WHITE, FlatEncoder, byte_level, chunk_starts, joined, slices
from vicinal.session import Scratch

#: Dimensions that hashed vectors are projected to, and bits of each in a Hilbert key.
DIMENSIONS, KEY_BITS = 4, 15
#: Places of a hashed vector, a power of two.
HASHED = 1 << 16


def hilbert(places: np.ndarray, bits: int = KEY_BITS) -> np.ndarray:
    """Position along the Hilbert curve of each row of whole coordinates below 2**bits.

    Skilling's transform: undo the rotations from the highest bit down, take the Gray code off, and read the bits of all
    coordinates in turn.
    """
    x = np.array(places, np.uint64).T.copy()
    one = np.uint64(1)
    for bit in range(bits - 1, 0, -1):
        high, below = one << np.uint64(bit), (one << np.uint64(bit)) - one
        for d in range(len(x)):
            swap = (x[0] ^ x[d]) & below
            inverted = (x[d] & high) > 0
            x[0] ^= np.where(inverted, below, swap)
            x[d] ^= np.where(inverted, np.uint64(0), swap)
    for d in range(1, len(x)):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, 0, -1):
        odd = (x[-1] & (one << np.uint64(bit))) > 0
        turn ^= np.where(odd, (one << np.uint64(bit)) - one, np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for row in x:
            key = (key << one) | ((row >> np.uint64(bit)) & one)
    return key.astype(np.int64)


class CurveKeys:
    """Hilbert keys of texts: words hashed to a long sparse vector, projected at random, direction only."""

    #: Places of a word's bytes after which weights repeat, and characters hashed at a time.
    PLACES, AT_ONCE = 64, 1 << 20

    def __init__(self, _=None):
        draw = np.random.default_rng(12)
        self.projection = draw.standard_normal((DIMENSIONS, HASHED))
        byte = np.arange(256)
        byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
        self.byte = draw.integers(1, 1 << 62, 256, dtype=np.uint64)[byte]
        self.weight = draw.integers(0, 1 << 62, self.PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def places(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The hashed place of each chunk; a white space before a word does not count, nor does its case in ASCII."""
        lead = ASCII_WHITE[data[starts]]
        at = np.arange(len(data)) - np.repeat(starts + lead, np.diff(np.append(starts, len(data))))
        term = self.byte[data]
        term *= self.weight[at & (self.PLACES - 1)]
        term[starts[lead]] = 0
        return (np.add.reduceat(term, starts) >> np.uint64(40)).astype(np.int64) & (HASHED - 1)

    def vectors(self, texts: list[str]) -> np.ndarray:
        """Projected vectors of how often each text has each hashed word."""
        out = np.zeros((len(texts), DIMENSIONS))
        for held in slices(texts, self.AT_ONCE):
            data, ends = joined([t for _, t in held])
            starts = chunk_starts(data, ends)
            if not len(starts):
                continue
            row = np.repeat([i for i, _ in held], np.diff(np.searchsorted(starts, ends), prepend=0))
            place = self.places(data, starts)
            for d in range(DIMENSIONS):
                out[:, d] += np.bincount(row, self.projection[d, place], len(texts))
        return out

    def __call__(self, texts: list[str]) -> np.ndarray:
        v = self.vectors(texts)
        size = np.sqrt((v * v).sum(axis=1, keepdims=True))
        direction = np.where(size > 0, v / np.where(size > 0, size, 1), 0.0)
        return hilbert(np.clip((direction + 1) / 2 * (1 << KEY_BITS), 0, (1 << KEY_BITS) - 1).astype(np.uint64))


def along_curve(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`_id`, `_text`, `_row` (a number for each row) and `_key` (its place on the curve)."""
    source = only(df, _id=id_col, _text=text_col)
    kind = arrow_type(source, "_id")
    tool = Shipped(df.sparkSession, None)

    def run(batches):
        gc.disable()
        keys = tool.made(CurveKeys)
        # Rows are numbered by partition and place; the table is written once, which makes the numbers stay.
        row = TaskContext.get().partitionId() << 36
        for held in blocks(((i, t or "") for i, t in rows_of(batches, "_id", "_text")), BLOCK_CHARS):
            texts = [t for _, t in held]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in held], kind),
                    pa.array(texts, pa.string()),
                    pa.array(np.arange(row, row + len(held))),
                    pa.array(keys(texts)),
                ],
                ["_id", "_text", "_row", "_key"],
            )
            row += len(held)

    return source.mapInArrow(run, f"_id {sql_type(source, '_id')}, _text string, _row long, _key long")


def sizes_of_rest(rest: int) -> list[int]:
    """Powers of two that add up to `rest`, largest first: sequences that need no padding."""
    return [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def pack_sequences(
    df: DataFrame,
    tokenizer_path: str,
    end_id: int,
    size: int = 2048,
    digest: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Cut and pack all documents into sequences of `size` ids; one row for each piece of a document.

    Columns: `id_col`, `start` (ids of the document before the piece), `length`, `ids` (or with `digest` their crc32 as
    little-endian 32-bit integers, `ids_crc32`), `doc_tokens`, `sequence_id`, `offset` (the piece's place in its
    sequence). Documents are sorted over all tasks by their place on a Hilbert curve through their contents, so
    that a sequence holds documents that are alike; each task fills one sequence after the other and cuts documents
    where one is full. What is left at a task's end becomes sequences of powers of two. No id is padding.

    A null or empty text has only the end id. Null and repeated ids: each row is a document of its own. Copies lie side by
    side, spread over tasks by a hash of the row where there are many. An empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    content = read_file(tokenizer_path).decode()
    if not byte_level(content):
        raise ValueError("only byte-level tokenizers without normaliser can be encoded word by word")
    if size < 1 or size & (size - 1):
        raise ValueError("the size of a sequence must be a power of two")
    tokenizer = Shipped(spark, content)
    placed = Scratch(spark).save(along_curve(df, id_col, text_col), "placed")
    kind = arrow_type(placed, "_id")
    byte_count = placed.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    order = [F.col("_key"), F.xxhash64("_row"), F.col("_row")]
    ordered = placed.repartitionByRange(shuffle_width(spark, byte_count), *order).sortWithinPartitions(*order)
    value, value_type = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int32()))

    def run(batches):
        gc.disable()
        encoder = tokenizer.made(FlatEncoder)
        sequence, used = TaskContext.get().partitionId() << 36, 0
        # The sequence that is being filled: its pieces, told once it is known to be whole.
        open_: list[tuple] = []

        def told(pieces):
            names = [id_col, "start", "length", value, "doc_tokens", "sequence_id", "offset"]
            columns = list(zip(*pieces, strict=True))
            kinds = [kind, pa.int64(), pa.int64(), value_type, pa.int64(), pa.int64(), pa.int64()]
            columns[3] = [zlib.crc32(p) if digest else np.frombuffer(p, "<i4") for p in columns[3]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for held in blocks(rows_of(batches, "_id", "_text"), BLOCK_CHARS):
            ids, ends = encoder.encode([t for _, t in held])
            # The end id after each document.
            whole = np.insert(ids, ends, end_id).astype("<u4")
            ends = (ends + np.arange(1, len(ends) + 1)).tolist()
            done, begin = [], 0
            for (i, _), end in zip(held, ends, strict=True):
                at = begin
                while at < end:
                    take = min(end - at, size - used)
                    open_.append((i, at - begin, take, whole[at : at + take].tobytes(), end - begin, sequence, used))
                    at, used = at + take, used + take
                    if used == size:
                        done += open_
                        open_, sequence, used = [], sequence + 1, 0
                begin = end
            if done:
                yield told(done)
        if open_:
            yield told(_split_rest(open_, sizes_of_rest(used)))

    schema = f"`{id_col}` {sql_type(placed, '_id')}, start long, length long, "
    schema += ("ids_crc32 long" if digest else "ids array<int>") + ", doc_tokens long, sequence_id long, offset long"
    return ordered.select("_id", "_text").mapInArrow(run, schema)


def _split_rest(pieces: list[tuple], sizes: list[int]) -> list[tuple]:
    """The pieces of an unfinished sequence, cut again into sequences of these sizes."""
    out, sizes, used, sequence = [], list(sizes), 0, pieces[0][5]
    for name, start, length, ids, doc_tokens, _, _ in pieces:
        at = 0
        while at < length:
            take = min(length - at, sizes[0] - used)
            out.append((name, start + at, take, ids[4 * at : 4 * (at + take)], doc_tokens, sequence, used))
            at, used = at + take, used + take
            if used == sizes[0]:
                del sizes[0]
                sequence, used = sequence + 1, 0
    return out
