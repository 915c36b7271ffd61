"""Byte-level BPE: encoding by replaying merges over a corpus of words, and decoding."""

from __future__ import annotations

import base64
import gc
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import BLOCK_CHARS, ChunkValues, Shipped, arrow_type, blocks, only, ragged, read_file, rows_of, sql_type
from vicinal.llm.merges import NEVER, MergeTable, every_other, merge_one

# Signs that the patterns of these files never join to a word before them; the pattern itself does the rest.
PLAIN_ENDS = (".", ",")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines `base64 rank`."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in read_file(path).splitlines() if line)}


def distinct(at: np.ndarray) -> np.ndarray:
    at = np.sort(at)
    return at[np.append(True, at[1:] != at[:-1])]


class Replay:
    """Encodes many words at once.

    All words lie in one array of symbols, linked to their neighbours. An inverted index leads from each
    pair, by the rank of what it makes, to the positions where it stands. Merges are applied in rank
    order, each to all its positions at once, and only the pairs beside them are looked up again.
    """

    def __init__(self, ranks: dict[bytes, int]):
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        self.table = MergeTable(left, right, made, made)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.whole = ranks

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as raw little-endian int32."""
        if not words:
            return []
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        n = int(ends[-1])
        if not n:
            return [b""] * len(words)
        sym = np.append(self.of_byte[np.frombuffer(b"".join(words), np.uint8)], -1)
        # Slot n stands for "no neighbour".
        nxt, prv = np.arange(1, n + 2), np.arange(-1, n)
        filled = lengths > 0
        nxt[ends[filled] - 1] = n
        prv[(ends - lengths)[filled]] = n
        word_of = np.repeat(np.arange(len(words)), lengths)
        ranks = np.full(n + 1, NEVER)
        doubtful = self._replay(sym, nxt, prv, ranks, n, word_of)

        alive = sym[:n] >= 0
        kept = sym[:n][alive].astype("<i4").tobytes()
        counts = np.bincount(word_of[alive], minlength=len(words))
        stops = np.cumsum(counts) * 4
        out = [kept[b - 4 * c : b] for b, c in zip(stops.tolist(), counts.tolist(), strict=True)]
        for w in doubtful:
            ids = merge_one(self.of_byte[np.frombuffer(words[w], np.uint8)].tolist(), self.table)
            out[w] = np.array(ids, "<i4").tobytes()
        return out

    def _replay(self, sym, nxt, prv, ranks, n, word_of) -> set[int]:
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        doubtful: set[int] = set()

        def look_up(at: np.ndarray) -> np.ndarray:
            right = nxt[at]
            found, _ = self.table.find(sym[at], sym[right])
            found[right == n] = NEVER
            ranks[at] = found
            return found

        def post(at: np.ndarray, found: np.ndarray, first: bool) -> None:
            """Enter positions into the index under the rank of their pair."""
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for r, part in zip(found[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    if first:
                        heap.append(r)
                    else:
                        heappush(heap, r)

        everywhere = np.arange(n)
        found = look_up(everywhere)
        if (found < NEVER).any():
            post(everywhere[found < NEVER], found[found < NEVER], True)
        heapify(heap)
        while heap:
            rank = heappop(heap)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else distinct(np.concatenate(lists))
            at = at[ranks[at] == rank]
            if not len(at):
                continue
            follows = np.zeros(len(at), bool)
            follows[1:] = nxt[at[:-1]] == at[1:]
            if follows.any():
                at = at[every_other(follows)]
            gone = nxt[at]
            after = nxt[gone]
            # A merge that makes an earlier one possible, if only until the next symbol is merged too: such a word
            # is done one merge at a time.
            beside, _ = self.table.find(np.full(len(at), rank), sym[after])
            doubtful.update(word_of[at[(beside <= rank) & (after < n)]].tolist())
            sym[at], sym[gone], ranks[gone] = rank, -1, NEVER
            nxt[at], prv[after] = after, at
            before = prv[at]
            touched = distinct(np.concatenate((before[before < n], at)))
            found = look_up(touched)
            fresh = found < NEVER
            if fresh.any():
                touched, found = touched[fresh], found[fresh]
                early = found <= rank
                if early.any():
                    doubtful.update(word_of[touched[early]].tolist())
                post(touched, found, False)
        return doubtful


class Encoder:
    """Ids of texts, by the replay of words not met before."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay = Replay(ranks)
        self.pattern = regex.compile(pattern)
        self.chunks = ChunkValues(self._learn)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk's matches of the pattern, every distinct match replayed once."""
        words: dict[str, int] = {}
        first, second, rest = [], [], {}
        for i, chunk in enumerate(chunks):
            bare = chunk[1:] if chunk[0] == " " else chunk
            if bare.isalpha():
                found = (chunk,)
            elif bare[-1:] in PLAIN_ENDS and bare[:-1].isalpha():
                found = (chunk[:-1], bare[-1])
            else:
                found = self.pattern.findall(chunk)
            first.append(words.setdefault(found[0], len(words)))
            second.append(words.setdefault(found[1], len(words)) if len(found) > 1 else -1)
            if len(found) > 2:
                rest[i] = [words.setdefault(w, len(words)) for w in found[2:]]
        ids = self.replay([w.encode() for w in words])
        ids.append(b"")
        out = [ids[a] + ids[b] for a, b in zip(first, second, strict=True)]
        for i, more in rest.items():
            out[i] += b"".join([ids[w] for w in more])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as raw little-endian int32."""
        return [b"".join(parts) for parts in self.chunks.of(texts, b"".join)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def encoder_of(vocabulary: tuple[dict[bytes, int], str]) -> Encoder:
    return Encoder(*vocabulary)


def encode_decode(
    df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Ids of every whole text and what those ids decode to: `id_col`, `ids` array<int>, `decoded` binary.

    The ids are those of the plain algorithm on each match of `pattern`, without special tokens. No shuffle:
    every task replays merges over the words of its own documents, block by block. All splits of a token into
    two tokens are merges, as in rank files.

    A null or empty text gives no ids and no bytes; ids may be null or repeat, each row is encoded; an empty
    table gives no rows; other columns are ignored.
    """
    vocabulary = Shipped(df.sparkSession, (read_ranks(ranks_path), pattern))

    def run(batches):
        gc.disable()  # nothing here makes cycles; tracing millions of strings takes longer than all else
        encoder = vocabulary.made(encoder_of)
        for held in blocks(((i, t or "") for i, t in rows_of(batches, "_id", "_text")), BLOCK_CHARS):
            ids = encoder.encode([t for _, t in held])
            decoded = [encoder.decode(np.frombuffer(x, "<i4")) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in held], kind), ragged(ids, "<i4"), pa.array(decoded, pa.binary())],
                [id_col, "ids", "decoded"],
            )

    source = only(df, _id=id_col, _text=text_col)
    kind = arrow_type(source, "_id")
    return source.mapInArrow(run, f"`{id_col}` {sql_type(source, '_id')}, ids array<int>, decoded binary")


def decode_ids(df: DataFrame, ranks_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that an array of ids stands for; null for a null array, an error for an unknown id."""
    ranks = Shipped(df.sparkSession, read_ranks(ranks_path))
    names = [c for c in df.columns if c != out]

    def run(batches):
        tokens = {rank: token for token, rank in ranks.broadcast.value.items()}
        for batch in batches:
            decoded = [None if x is None else b"".join([tokens[i] for i in x]) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(decoded, pa.binary())], [*names, out]
            )

    plain = df.select(*(F.col(f"`{n}`") for n in names))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{fields}, `{out}` binary")


def encoding_digest(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Count and digests of what `encode_decode` returns."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
