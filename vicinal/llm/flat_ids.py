"""Texts as arrays of chunk numbers, and their token ids gathered from what each distinct chunk gives."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from vicinal.llm.common import WHITE

# White space of one byte in UTF-8, and the byte sequences of the rest.
ASCII_WHITE = np.zeros(256, bool)
ASCII_WHITE[[9, 10, 11, 12, 13, 32]] = True
LONGER_WHITE = [c.encode() for c in map(chr, range(0x80, 0x3001)) if c.isspace() and c not in "\x1c\x1d\x1e\x1f"]
_LONGER = tuple(LONGER_WHITE)
#: Distinct chunks that a Python worker remembers.
CHUNKS_HELD = 400_000
#: Bytes of a text that are cut into chunks at a time.
SLICE_BYTES = 8 << 20


def _after_longer_white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space of two or three bytes ends right before each place."""
    out = np.zeros(len(at), bool)
    for white in LONGER_WHITE:
        held = at >= len(white)
        for k, byte in enumerate(reversed(white), 1):
            held &= data[np.maximum(at - k, 0)] == byte
        out |= held
    return out


def cuts(data: np.ndarray, only_spaces: bool = False) -> np.ndarray:
    """Places in UTF-8 bytes where white space of one byte follows what is none; `only_spaces`: only a space does.

    Tokenizers' patterns end a match there and look no further, so that what lies between can be encoded by itself.
    """
    white = ASCII_WHITE[data]
    here = (data[1:] == 32) if only_spaces else white[1:]
    at = np.flatnonzero(here & ~white[:-1]) + 1
    doubtful = np.flatnonzero(data[at - 1] >= 0x80)
    if len(doubtful):
        keep = np.ones(len(at), bool)
        keep[doubtful] = ~_after_longer_white(data, at[doubtful])
        at = at[keep]
    return at


def chunk_starts(data: np.ndarray, ends: np.ndarray, only_spaces: bool = False) -> np.ndarray:
    """Where the chunks begin of texts that lie one after the other."""
    begins = np.append(0, ends[:-1])
    begun = np.zeros(len(data), bool)
    begun[begins[begins < ends]] = True
    if len(data):
        begun[cuts(data, only_spaces)] = True
    return np.flatnonzero(begun)


class Chunks:
    """Numbers for distinct chunks, told from a dictionary that Arrow makes of each block of texts.

    `learn` takes a list of new chunks (bytes) and tells what it needs of them in their order; numbers go on from there
    until too many are held, or more than `held_bytes` of them: then `forget` is called and they begin anew. Forgetting
    changes no result.
    """

    def __init__(self, learn, forget, only_spaces: bool = False, held: int = CHUNKS_HELD, held_bytes: int | None = None):
        self.learn, self.forget, self.only_spaces, self.held, self.held_bytes = learn, forget, only_spaces, held, held_bytes
        self.known: dict[bytes, int] = {}
        self.known_bytes = 0

    def full(self) -> bool:
        """Whether numbers will begin anew."""
        return len(self.known) > self.held or (self.held_bytes is not None and self.known_bytes > self.held_bytes)

    def numbers(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each chunk of texts that lie one after the other, and how many chunks there are up to
        each text's end."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
        starts = chunk_starts(data, ends, self.only_spaces)
        offsets = np.append(starts, len(data)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self.full():
            self.known.clear()
            self.known_bytes = 0
            self.forget()
        get = self.known.get
        number = np.array([get(c, -1) for c in distinct], np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh = [distinct[i] for i in new.tolist()]
            first = len(self.known)
            self.learn(fresh)
            self.known.update(zip(fresh, range(first, first + len(fresh))))
            self.known_bytes += sum(map(len, fresh))
            number[new] = np.arange(first, first + len(fresh))
        return number[coded.indices.to_numpy()], np.searchsorted(starts, ends)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and where each ends."""
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw], dtype=np.int64)


def slices(texts: list[str], limit: int = SLICE_BYTES):
    """Lists of (row, part of the text) of about `limit` characters; long texts in parts that end where a chunk does."""
    held, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at > limit:
            end = _pause(text, at + limit)
            held.append((i, text[at:end]))
            yield held
            held, size, at = [], 0, end
        held.append((i, text[at:] if at else text))
        size += len(held[-1][1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def _pause(text: str, at: int) -> int:
    """The first place from `at` on where a space follows what is no white space, else the end."""
    while (at := text.find(" ", at)) >= 0:
        if text[at - 1] not in _WHITE:
            return at
        at += 1
    return len(text)


_WHITE = frozenset(chr(p) for p in range(0x3001) if chr(p).isspace()) | frozenset(WHITE)


def distinct(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers in order, and how often each comes; by sorting, which is the faster way for many."""
    ordered = np.sort(numbers)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
    return ordered[first], np.diff(np.append(first, len(ordered)))


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class FlatEncoder:
    """Ids of texts under a byte-level tokenizer by the tokenizers library, asked once for each distinct chunk.

    `plain`: strings of special tokens inside texts are ordinary text.
    """

    #: Chunks given to the library as one text.
    TOGETHER = 256

    def __init__(self, tokenizer: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer)
        self.library.encode_special_tokens = plain
        # Byte-level tokens have a character for each byte; special ones stand for their own text.
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(self.library.get_vocab().values()) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = list(map(len, vocabulary))
        for number, token in self.library.get_added_tokens_decoder().items():
            self.bytes_of[number] = len(token.content.encode())
        self.chunks = Chunks(self._learn, self._forget)
        self._forget()

    def _forget(self) -> None:
        self.flat, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _learn(self, chunks: list[bytes]) -> None:
        flat, length = self.ids_of(chunks)
        self.flat, self.length = np.concatenate([self.flat, flat]), np.concatenate([self.length, length])
        self.start = np.cumsum(self.length) - self.length

    def ids_of(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one after the other, and how many each has."""
        # Chunks that begin with white space and end with none end a match where they do: many make one text.
        white = ASCII_WHITE.tolist()
        edges = np.array([white[c[0]] and not (white[c[-1]] if c[-1] < 0x80 else c.endswith(_LONGER)) for c in chunks], bool)
        together, alone = np.flatnonzero(edges), np.flatnonzero(~edges)
        groups = [
            b"".join([chunks[i] for i in together[at : at + self.TOGETHER].tolist()]).decode()
            for at in range(0, len(together), self.TOGETHER)
        ]
        length = np.zeros(len(chunks), np.int64)
        parts = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(groups, add_special_tokens=False)]
        ids = np.concatenate([np.zeros(0, np.uint32), *parts])
        ends = np.cumsum([len(chunks[i]) for i in together.tolist()], dtype=np.int64)
        upto = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
        length[together] = np.diff(upto, prepend=0)
        encoded = self.library.encode_batch_fast([chunks[i].decode() for i in alone.tolist()], add_special_tokens=False)
        own = [np.array(e.ids, np.uint32) for e in encoded]
        length[alone] = [len(x) for x in own]
        start = np.cumsum(length) - length
        flat = np.zeros(int(length.sum()), np.uint32)
        flat[runs(start[together], length[together])] = ids
        flat[runs(start[alone], length[alone])] = np.concatenate([np.zeros(0, np.uint32), *own])
        return flat, length

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's end."""
        out, counts = [], np.zeros(len(texts), np.int64)
        for held in slices(texts):
            number, upto = self.chunks.numbers(*joined([t for _, t in held]))
            length = self.length[number]
            out.append(self.flat[runs(self.start[number], length)] if len(number) else np.zeros(0, np.uint32))
            per_text = np.diff(np.append(0, np.cumsum(length))[np.append(0, upto)])
            np.add.at(counts, [i for i, _ in held], per_text)
        return np.concatenate([np.zeros(0, np.uint32), *out]), np.cumsum(counts)


def byte_level(tokenizer: str) -> bool:
    """Whether texts may be encoded chunk by chunk: a byte-level pattern, nothing that looks across chunks."""
    told = json.loads(tokenizer)
    before = told.get("pre_tokenizer") or {}
    return (
        before.get("type") == "ByteLevel"
        and before.get("use_regex", True)
        and not before.get("add_prefix_space")
        and not told.get("normalizer")
        and not told.get("truncation")
        and not any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in told["added_tokens"])
    )
