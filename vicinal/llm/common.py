"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

# The white space that the tokenizers' patterns know as \s (Unicode White_Space).
WHITE = "\t-\r \x85\xa0" + "{}{}-{}{}{}{}{}{}".format(*map(chr, (0x1680, 0x2000, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# Characters of a text split at a time, and of documents held together; bounds memory for texts of any length.
SEGMENT_CHARS = 1 << 20
BLOCK_CHARS = 4 << 20
# Chunks a Python worker remembers; beyond it, it forgets most and goes on.
CHUNKS_HELD = 400_000
SHORT = 8
# Fixed value: what the contracts take for white space.
SPACES = r"[\x20\x09-\x0D]"


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


class ChunkValues:
    """What `learn` makes of each distinct chunk of a text, looked up for whole texts.

    A chunk is a run of `white` characters with the word after it. Tokenizer patterns end a match where a
    chunk ends, and look no further than the first character after white space, so chunks can be encoded by
    themselves. `learn` takes a list of chunks and returns a list of values, none of them None; forgetting chunks changes no
    value. `lead`: a space is put before every text.
    """

    def __init__(self, learn, white: str = WHITE, lead: bool = False):
        self.learn, self.lead = learn, lead
        self.chunk = re.compile(f"[{white}]*[^{white}]+|[{white}]+")
        # Single spaces between words part the same chunks, faster; this finds texts where they don't.
        self.uneven = re.compile(f" [{white}]|[{white}] ")
        self.pause = re.compile(f"[^{white}] [^{white}]")
        self.exact: dict[str, object] = {}
        # By the chunk without its one leading space, which saves making that string.
        self.spaced: dict[str, object] = {}

    def _segments(self, text: str):
        """`text` in parts of bounded length that end where a chunk does."""
        at = 0
        while len(text) - at > SEGMENT_CHARS and (found := self.pause.search(text, at + SEGMENT_CHARS)):
            yield text[at : found.start() + 1]
            at = found.start() + 1
        yield text[at:] if at else text

    def _split(self, text: str) -> tuple[list[str], list[str]]:
        """Chunks as they are, and after them chunks without their leading space."""
        if self.uneven.search(text):
            return self.chunk.findall(text), []
        first, *words = text.split(" ")
        return ([first] if first else []), words

    def _forget(self) -> None:
        """If too many chunks are held, keep short ones, which come again most; if those are too many, none."""
        if len(self.exact) + len(self.spaced) > CHUNKS_HELD:
            self.exact.clear()
            self.spaced = {c: v for c, v in self.spaced.items() if len(c) <= SHORT}
            if len(self.spaced) > CHUNKS_HELD // 2:
                self.spaced.clear()

    def of(self, texts: list[str], combine) -> list[list]:
        """For each text the list of `combine(values of a part)`."""
        out: list[list] = [[] for _ in texts]
        queue = (
            (i, part) for i, text in enumerate(texts) if text for part in self._segments(" " + text if self.lead else text)
        )
        for held in blocks(queue, BLOCK_CHARS):
            self._forget()
            # Every chunk is looked up once; those not met before are learned together and filled in.
            parts = [self._split(part) for _, part in held]
            found = [([*map(self.exact.get, heads)], [*map(self.spaced.get, words)]) for heads, words in parts]
            exact, spaced = set(), set()
            for (heads, words), (known_heads, known_words) in zip(parts, found, strict=True):
                exact.update([c for c, v in zip(heads, known_heads, strict=True) if v is None])
                spaced.update([w for w, v in zip(words, known_words, strict=True) if v is None])
            exact, spaced = list(exact), list(spaced)
            values = self.learn(exact + [" " + w for w in spaced])
            self.exact.update(zip(exact, values))
            self.spaced.update(zip(spaced, values[len(exact) :]))
            for (i, _), pair, known in zip(held, parts, found, strict=True):
                filled = [
                    v if v is not None else table[c]
                    for table, chunks, had in zip((self.exact, self.spaced), pair, known, strict=True)
                    for c, v in zip(chunks, had, strict=True)
                ]
                out[i].append(combine(filled))
        return out


def read_file(path: str) -> bytes:
    """A vocabulary file, read on the driver so that executors need no copy; its size does not depend on the data."""
    return Path(path).read_bytes()


class Shipped:
    """A model or vocabulary of bounded size, sent to every executor once."""

    def __init__(self, spark: SparkSession, content: object):
        self.broadcast = spark.sparkContext.broadcast(content)
        self.key = uuid.uuid4().hex

    def made(self, make):
        """`make(content)`, made once in each Python worker and kept from task to task."""
        if _made.get(make.__qualname__, (None,))[0] != self.key:
            _made[make.__qualname__] = (self.key, make(self.broadcast.value))
        return _made[make.__qualname__][1]


_made: dict[str, tuple[str, object]] = {}


def shuffle_width(spark: SparkSession, byte_count: float, per_task: int = 64 << 20) -> int:
    """Partitions for `byte_count` bytes: the session's width, or more if tasks would get over `per_task`."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(byte_count // per_task) + 1)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names, so that other columns can be called anything."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def ragged(parts: list[bytes], dtype) -> pa.Array:
    """A list array with one list per item of `parts`, which hold raw little-endian numbers."""
    size = np.dtype(dtype).itemsize
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // size for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype)))


def blocks(texts, limit: int):
    """Group (row, text) pairs into lists of about `limit` characters, at least one text each."""
    held, size = [], 0
    for item in texts:
        held.append(item)
        size += len(item[1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def letter_slices(items, limit: int):
    """(row, text) pairs with texts over `limit` in parts, cut before a character that is no letter: words, and what is
    counted of letters in a row, lie in one part each."""
    for i, text in items:
        at = 0
        while len(text) - at > limit:
            end = at + limit
            while end < len(text) and text[end].isalpha():
                end += 1
            yield i, text[at:end]
            at = end
        if not at or at < len(text):
            yield i, text[at:] if at else text


def rows_of(batches, *names: str):
    """Tuples of the named columns, a bounded slice of each batch at a time; a null text comes as None."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


def arrow_type(df: DataFrame, name: str) -> pa.DataType:
    return to_arrow_type(df.schema[name].dataType)


def sql_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
