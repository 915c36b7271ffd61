"""Token counts of a sentence-piece BPE model, by merging all words of a batch in step."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import BLOCK_CHARS, ChunkValues, Shipped, arrow_type, blocks, only, read_file, rows_of, sql_type
from vicinal.llm.merges import NEVER, MergeTable, every_other, merge_one

# Fixed value: what the model's files write for a space.
SPACE = "▁"


class PieceCounter:
    """Counts the tokens of texts under one model, which must be BPE with byte fallback and no normaliser."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_proto=model)
        size = library.get_piece_size()
        plain = [
            i for i in range(size) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))
        ]
        pieces = [library.id_to_piece(i) for i in plain]
        probe = "a  ﬁ\tb İ１ "
        if (
            any(library.is_unused(i) for i in plain)
            or sum(library.is_byte(i) for i in range(size)) != 256
            or library.normalize(probe) != SPACE + probe.replace(" ", SPACE)
            or any(SPACE in p.lstrip(SPACE) for p in pieces)
            or library.encode("  " + SPACE, out_type=str) != library.encode(" " * 3, out_type=str)
        ):
            raise ValueError("the model normalises text, has pieces that span words, or has no byte fallback")

        symbols = {p: n for n, p in enumerate(pieces)}
        for c in sorted({c for p in pieces for c in p}):
            symbols.setdefault(c, len(symbols))
        names = list(symbols)
        # Tokens each symbol stands for in the end: one, or its bytes if it is no piece. The last four
        # symbols are characters that occur in no piece, by their number of bytes.
        self.weight = np.array([1] * len(pieces) + [len(s.encode()) for s in names[len(pieces) :]] + [1, 2, 3, 4])
        points = np.arange(0x110000)
        self.of_point = len(names) + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        for s, n in symbols.items():
            if len(s) == 1:
                self.of_point[ord(s)] = n

        scores = np.array([library.get_score(i) for i in plain])
        ranks = np.unique(-scores, return_inverse=True)[1]
        left, right, made, rank = [], [], [], []
        for n, piece in enumerate(pieces):
            for i in range(1, len(piece)):
                a, b = symbols.get(piece[:i]), symbols.get(piece[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(n)
                    rank.append(ranks[n])
        self.table = MergeTable(left, right, made, rank)
        self.chunks = ChunkValues(self.count_words, white=" " + SPACE, lead=True)

    def count_words(self, words: list[str]) -> list[int]:
        """Tokens of each word.

        The words' symbols lie in one ragged array. Every round finds each word's lowest rank and merges all
        pairs of that rank; words with no pair left are counted and leave the array.
        """
        if not words:
            return []
        lengths = np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), np.uint32)
        sym = self.of_point[points]
        counts = np.zeros(len(words), np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        rank, made = np.full(len(sym), NEVER), np.full(len(sym), -1)
        stale = np.ones(len(sym), bool)
        low = np.full(len(words), -1)
        doubtful: set[int] = set()
        while len(sym):
            inside = np.append(word[1:] == word[:-1], False)
            rank[~inside] = NEVER
            renewed = np.flatnonzero(stale & inside)
            rank[renewed], made[renewed] = self.table.find(sym[renewed], sym[renewed + 1])
            # A merge made a pair that should have come before it or with it: do that word one merge at a time.
            early = renewed[rank[renewed] <= low[word[renewed]]]
            if len(early):
                doubtful.update(word[early].tolist())
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            low[word[starts]] = best
            lowest = np.repeat(best, np.diff(np.append(starts, len(sym))))
            done = lowest == NEVER
            if done.any():
                counts += np.bincount(word[done], self.weight[sym[done]], len(words)).astype(np.int64)
                keep = ~done
                sym, word, rank, made, lowest = sym[keep], word[keep], rank[keep], made[keep], lowest[keep]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == lowest)
            follows = np.append(False, at[1:] == at[:-1] + 1)
            if follows.any():
                at = at[every_other(follows)]
            # The same if that pair is there only until the next symbol is merged too.
            near = at[(at + 2 < len(sym))]
            near = near[word[near + 2] == word[near]]
            beside, _ = self.table.find(made[near], sym[near + 2])
            doubtful.update(word[near[beside <= lowest[near]]].tolist())
            sym[at] = made[at]
            stale = np.zeros(len(sym), bool)
            stale[at] = True
            stale[at[at > 0] - 1] = True
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, word, rank, made, stale = sym[keep], word[keep], rank[keep], made[keep], stale[keep]
        ends = np.cumsum(lengths)
        for w in doubtful:
            symbols = self.of_point[points[ends[w] - lengths[w] : ends[w]]].tolist()
            counts[w] = self.weight[merge_one(symbols, self.table)].sum()
        return counts.tolist()

    def count(self, texts: list[str]) -> list[int]:
        return [sum(parts) for parts in self.chunks.of(texts, sum)]


def token_counts(
    df: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokens of every whole text under a sentence-piece model: `id_col`, `n_bytes`, `n_tokens`, `over_limit`.

    Counts are the library's defaults: no begin or end token, nothing cut. No shuffle; a task counts each
    distinct word once while it remembers it.

    A null or empty text has no tokens; ids may be null or repeat, each row is counted; an empty table gives
    no rows; other columns are ignored.
    """
    model = Shipped(df.sparkSession, read_file(model_path))
    source = only(df, _id=id_col, _text=text_col).select(
        "_id", "_text", F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long").alias("_bytes")
    )
    kind = arrow_type(source, "_id")

    def run(batches):
        gc.disable()
        counter = model.made(PieceCounter)
        for held in blocks(((i, t or "", b) for i, t, b in rows_of(batches, "_id", "_text", "_bytes")), BLOCK_CHARS):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _, _ in held], kind),
                    pa.array([b for _, _, b in held], pa.int64()),
                    pa.array(counter.count([t for _, t, _ in held]), pa.int64()),
                ],
                [id_col, "n_bytes", "n_tokens"],
            )

    counted = source.mapInArrow(run, f"`{id_col}` {sql_type(source, '_id')}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
