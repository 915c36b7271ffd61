"""Token files: ids of documents packed by word-aligned coding, written and read by Spark.

Format. A token table is a folder of Parquet files, one row for each block:

    shard, block    place of the block; blocks of a shard are numbered from 0
    ids             number of ids in the block
    words           64-bit little-endian words, each a selector (top four bits) and its packed ids
    escapes         64-bit ids that no selector holds; stand where a word of one id has all its bits set
    doc_ids         documents of the block, in order; a document never leaves its block
    doc_ends        where each document's ids end in the block
    marks           words before every LANE ids; decoding can start at each, and does at all of them together

The order of documents is that of (shard, block, place).
"""

from __future__ import annotations

import gc
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.llm.common import BLOCK_CHARS, Shipped, arrow_type, blocks, only, read_file, rows_of, shuffle_width
from vicinal.llm.flat_ids import FlatEncoder, byte_level
from vicinal.operators.prefix import running_total
from vicinal.session import Scratch

# Ids in a word of each selector 0 to 13; each gets 60 // count bits.
COUNTS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
BITS = 60 // COUNTS
ESCAPED = np.uint64((1 << 60) - 1)
#: Ids packed by themselves; a word doesn't go beyond.
LANE = 1024
#: A block closes with the document that takes it to so many ids.
BLOCK_IDS = 1 << 20


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, 60 at most; one too many for some ids over 2**53."""
    if ids.max(initial=0) < len(_BITS_OF):
        return _BITS_OF[ids.astype(np.int64)]
    return np.minimum(np.frexp(ids.astype(np.float64))[1], 60).astype(np.uint8)


_BITS_OF = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes, and the number of words before each lane, for unsigned ids.

    Every LANE ids are packed by themselves, all such lanes together: each word takes as many of the lane's
    next ids as fit, and a lane's last word is filled up with zeros.
    """
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    lanes = -(-n // LANE)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    escapes = ids[ids >= ESCAPED]
    held = np.zeros((lanes, LANE + 60), np.uint64)
    whole = np.zeros(lanes * LANE, np.uint64)
    whole[:n] = np.minimum(ids, ESCAPED)
    held[:, :LANE] = whole.reshape(lanes, LANE)
    # Selectors whose bits hold the ids from each place on; if one does, so do all of fewer ids.
    widest = {1: _bits(held)}
    choice = np.zeros((lanes, LANE), np.uint8)
    for selector in range(1, len(COUNTS)):
        count = int(COUNTS[selector])
        # The most bits among `count` ids from each place on, from two shorter runs that cover them.
        part = max(c for c in widest if c < count)
        run, size = widest[part], LANE + 60 - count + 1
        widest[count] = np.maximum(run[:, :size], run[:, count - part : count - part + size])
        fits = widest[count][:, :LANE] <= BITS[selector]
        if not fits.any():
            break
        choice += fits
    flat = choice.ravel()
    step = COUNTS[flat]
    ends = np.minimum(np.arange(1, lanes + 1) * LANE, n)
    at, open_, found = np.arange(lanes) * LANE, np.arange(lanes), []
    while len(at):
        found.append(at)
        at = at + step[at]
        more = at < ends[open_]
        at, open_ = at[more], open_[more]
    starts = np.sort(np.concatenate(found))
    chosen = flat[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    place = starts + starts // LANE * 60
    values = held.ravel()
    for selector in np.unique(chosen):
        mine = np.flatnonzero(chosen == selector)
        bits, base, packed = int(BITS[selector]), place[mine], words[mine]
        for k in range(COUNTS[selector]):
            packed |= values[base + k] << np.uint64(k * bits)
        words[mine] = packed
    return words, escapes, np.searchsorted(starts, np.arange(lanes) * LANE)


def unpack(words: np.ndarray, escapes: np.ndarray, marks: np.ndarray, n: int) -> np.ndarray:
    """The `n` ids that `pack` was given; all words of a selector are taken apart together."""
    words, marks = np.asarray(words, np.uint64), np.asarray(marks, np.int64)
    out = np.zeros((len(marks), LANE + 60), np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    before = np.cumsum(COUNTS[chosen]) - COUNTS[chosen]
    lane = np.repeat(np.arange(len(marks)), np.diff(np.append(marks, len(words))))
    place = lane * (LANE + 60) + before - before[marks][lane] if len(words) else before
    flat = out.reshape(-1)
    for selector in np.unique(chosen):
        mine = np.flatnonzero(chosen == selector)
        bits = np.uint64(BITS[selector])
        shifts = np.arange(COUNTS[selector], dtype=np.uint64) * bits
        mask = (np.uint64(1) << bits) - np.uint64(1)
        flat[place[mine, None] + np.arange(COUNTS[selector])] = (words[mine, None] >> shifts) & mask
    ids = np.ascontiguousarray(out[:, :LANE]).reshape(-1)[:n]
    if len(escapes):
        ids[ids == ESCAPED] = escapes
    return ids


class LibraryEncoder:
    """Ids of each text, as bytes, by the tokenizers library, asked once for each distinct chunk."""

    def __init__(self, tokenizer: str):
        self.flat = FlatEncoder(tokenizer)

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.flat.encode(texts)
        raw, stops = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]


def write_tokens(
    df: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode every whole text, append `end_id`, and write the ids as a token table in ascending id order.

    Documents are range-partitioned by id (splitters sampled by Spark), so shards follow each other and
    none depends on another. A null or empty text has only the end id. A null id comes first; rows with
    equal ids stay side by side in any order. An empty table writes no block. Other columns are ignored.
    """
    spark = df.sparkSession
    content = read_file(tokenizer_path).decode()
    if not byte_level(content):
        raise ValueError("only byte-level tokenizers without normaliser can be encoded word by word")
    tokenizer = Shipped(spark, content)
    source = only(df, _id=id_col, _text=text_col)
    kind = source.schema["_id"].dataType
    arrow_kind = arrow_type(source, "_id")
    end = np.array([end_id], "<u4").tobytes()
    schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("block", T.IntegerType()),
            T.StructField("ids", T.LongType()),
            T.StructField("words", T.BinaryType()),
            T.StructField("escapes", T.BinaryType()),
            T.StructField("doc_ids", T.ArrayType(kind)),
            T.StructField("doc_ends", T.ArrayType(T.LongType())),
            T.StructField("marks", T.BinaryType()),
        ]
    )

    def run(batches):
        gc.disable()
        encoder = tokenizer.made(LibraryEncoder)
        shard, block = TaskContext.get().partitionId(), 0
        names, parts, size = [], [], 0

        def close():
            nonlocal names, parts, size, block
            ids = np.frombuffer(b"".join(parts), "<u4")
            words, escapes, marks = pack(ids)
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([words.astype("<u8").tobytes()], pa.binary()),
                    pa.array([escapes.astype("<u8").tobytes()], pa.binary()),
                    pa.array([names], pa.list_(arrow_kind)),
                    pa.array([np.cumsum([len(p) // 4 for p in parts])], pa.list_(pa.int64())),
                    pa.array([marks.astype("<u4").tobytes()], pa.binary()),
                ],
                schema.names,
            )
            names, parts, size, block = [], [], 0, block + 1
            return row

        for held in blocks(((i, t or "") for i, t in rows_of(batches, "_id", "_text")), BLOCK_CHARS):
            for (i, _), ids in zip(held, encoder.encode([t for _, t in held]), strict=True):
                names.append(i)
                parts.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= BLOCK_IDS:
                    yield close()
        if names:
            yield close()

    size = source.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    ordered = source.repartitionByRange(shuffle_width(spark, size), "_id").sortWithinPartitions("_id")
    ordered.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Documents of a token table: the id, `start` (ids of all documents before it), `n_tokens`, `ids` array<long>."""
    return _read(spark, path, id_col, "ids array<long>", lambda ids: ids.astype(np.int64).tolist(), pa.list_(pa.int64()))


def read_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """As `read_tokens`, with `ids_crc32` (of the ids as little-endian 32-bit integers) in the place of the ids."""
    return _read(spark, path, id_col, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())


def _read(spark: SparkSession, path: str, id_col: str, column: str, value, value_type) -> DataFrame:
    table = spark.read.parquet(path)
    # One row a block, then one a shard, which is one task's output.
    totals = table.groupBy("shard", "block").agg(F.sum("ids").alias("ids"))
    in_shard = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = totals.select("shard", "block", F.coalesce(F.sum("ids").over(in_shard), F.lit(0)).alias("_in_shard"))
    scratch = Scratch(spark)
    sums = scratch.save(table.groupBy("shard").agg(F.sum("ids").alias("_ids")), "shards")
    shards = running_total(sums, ["shard"], F.col("_ids"), "_before", scratch).select("shard", "_before")
    kind = table.schema["doc_ids"].dataType.elementType
    arrow_kind = arrow_type(table.select(F.explode("doc_ids").alias("_id")), "_id")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, escapes, marks = (
                    np.frombuffer(row[c], t) for c, t in (("words", "<u8"), ("escapes", "<u8"), ("marks", "<u4"))
                )
                ids = unpack(words, escapes, marks, row["ids"])
                ends = row["doc_ends"]
                starts = [0, *ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], arrow_kind),
                        pa.array([row["shard"]] * len(ends), pa.int32()),
                        pa.array([row["block"]] * len(ends), pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()),
                        pa.array([value(ids[a:b]) for a, b in zip(starts, ends, strict=True)], value_type),
                    ],
                    ["_id", "shard", "block", "_at", "n_tokens", column.split()[0]],
                )

    schema = f"_id {kind.simpleString()}, shard int, block int, _at long, n_tokens long, {column}"
    return (
        table.select("shard", "block", "ids", "words", "escapes", "doc_ids", "doc_ends", "marks")
        .mapInArrow(run, schema)
        .join(within, ["shard", "block"])
        .join(shards, "shard")
        .select(
            F.col("_id").alias(id_col),
            (F.col("_before") + F.col("_in_shard") + F.col("_at")).alias("start"),
            "n_tokens",
            column.split()[0],
        )
    )
