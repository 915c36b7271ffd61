"""Words one edit apart, and the common form that a rare spelling belongs to."""

from __future__ import annotations

import gc
import math
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import SEGMENT_CHARS, only, rows_of, shuffle_width
from vicinal.session import Scratch

# The letters of a run, and those that are lower-cased.
LETTERS = "[A-Za-zÀ-ÿ]"
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
#: Symbols that a word's code points are numbered by, in their order: a to z, then U+00C0 to U+00FF.
SYMBOLS = 26 + 64
#: Words, and letters, that a cell holds on each side; beyond it a group of words is compared block by block.
CELL_WORDS, CELL_LETTERS = 8_192, 4 << 20
#: Rows of one side of a matrix product, and rows of small groups that are multiplied together.
TILE = 1_024
#: Words counted together before their counts leave a task.
WORDS_HELD = 500_000


def spelled(run: str, doc_id: object, spoilt: int = 31) -> str:
    """`run` in lower case, with one code point taken out if the crc32 of id and run says so; a null id is empty."""
    run = run.lower() if run.isascii() else run.translate(LOWER)
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % spoilt:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(df: DataFrame, least_letters: int, spoilt: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`word`, `n`: how often each spelling of at least `least_letters` comes in the whole texts."""
    # Spelling takes letters away and adds none, so shorter runs need no look.
    run_of = re.compile(f"{LETTERS}{{{least_letters},}}")
    fixed = {"lower": LOWER, "spoilt": spoilt}

    def run(batches):
        gc.disable()
        crc, lower, spoilt_by = zlib.crc32, fixed["lower"], fixed["spoilt"]
        counts: dict[str, int] = {}
        for i, text in rows_of(batches, "_id", "_text"):
            if not text:
                continue
            start = crc(f"{'' if i is None else i}:".encode())
            found = run_of.findall(text) if len(text) <= SEGMENT_CHARS else (m.group() for m in run_of.finditer(text))
            for word in found:
                word = word.lower() if word.isascii() else word.translate(lower)
                h = crc(word.encode(), start)
                if not h % spoilt_by:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < least_letters:
                        continue
                counts[word] = counts.get(word, 0) + 1
            if len(counts) >= WORDS_HELD:
                yield _counted(counts)
                counts.clear()
        if counts:
            yield _counted(counts)

    found = only(df, _id=id_col, _text=text_col).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


class LetterParts:
    """The letters in `parts` sets, and for each choice of two sets the hash of a word's counts of all other letters.

    One edit changes the counts of two letters at most, so of at most two sets: two words one edit apart agree in the
    hash of some choice.
    """

    def __init__(self, parts: int):
        self.part = np.arange(SYMBOLS) % parts
        self.choices = list(combinations(range(parts), 2))
        self.others = np.array([~np.isin(self.part, choice) for choice in self.choices])
        mixed = np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        self.number = mixed ^ (mixed >> np.uint64(31))
        # By the sets that differ, as bits: the first choice that holds them all.
        self.first = np.full(1 << parts, -1)
        for mask in range(1 << parts):
            for k, choice in enumerate(self.choices):
                if not mask & ~sum(1 << p for p in choice):
                    self.first[mask] = k
                    break

    def keys(self, words: list[str]) -> np.ndarray:
        """One hash a choice for each word, as signed 64-bit numbers."""
        symbols, lengths = symbols_of(words)
        row = np.repeat(np.arange(len(words)), lengths)
        out = np.zeros((len(self.choices), len(words)), np.uint64)
        for k, other in enumerate(self.others):
            mine = other[symbols]
            np.add.at(out[k], row[mine], self.number[symbols[mine]])
        return out.view(np.int64)

    def first_choice(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of rows of letter counts that differ in two letters at most: the choice that finds them first."""
        differ = a != b
        mask = np.zeros(len(a), np.int64)
        for p in range(self.part.max() + 1):
            mask |= differ[:, self.part == p].any(axis=1).astype(np.int64) << p
        return self.first[mask]


def symbols_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words' code points one after the other, and the words' lengths."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(points < 0x80, points - ord("a"), points - 0xC0 + 26), np.array([len(w) for w in words], np.int64)


class Near:
    """Near words among words in cells: products of blocks of letter counts, then edits verified."""

    def __init__(self, parts: LetterParts):
        self.parts = parts

    def __call__(self, words: list[str], n: np.ndarray, cell: np.ndarray, choice: np.ndarray, side: np.ndarray, cross: bool):
        """(row, near words, the largest n among them, the row that has it) for rows with any.

        Rows are words; pairs lie in one cell, on both its sides if `cross`, and are told only by the choice that
        finds them first.
        """
        symbols, lengths = symbols_of(words)
        ends = np.cumsum(lengths)
        left, right = [], []
        for length in np.unique(lengths).tolist():
            same, longer = np.flatnonzero(lengths == length), np.flatnonzero(lengths == length + 1)
            if len(same) + len(longer) < 2:
                continue
            a = self._block(symbols, ends, same, length)
            b = self._block(symbols, ends, longer, length + 1)
            for i, j in self._pairs(a, same, a, same, 2, cell, side, cross):
                at_i, at_j = np.searchsorted(same, i), np.searchsorted(same, j)
                for part in self._slices(len(i), length):
                    one = (a[0][at_i[part]] != a[0][at_j[part]]).sum(axis=1) == 1
                    self._keep(left, right, i[part][one], j[part][one], a[1][at_i[part][one]], a[1][at_j[part][one]], choice)
            for i, j in self._pairs(a, same, b, longer, 1, cell, side, cross):
                at_i, at_j = np.searchsorted(same, i), np.searchsorted(longer, j)
                for part in self._slices(len(i), length):
                    short, long = a[0][at_i[part]], b[0][at_j[part]]
                    ahead = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
                    behind = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
                    one = ahead + behind >= length
                    self._keep(left, right, i[part][one], j[part][one], a[1][at_i[part][one]], b[1][at_j[part][one]], choice)
        if not left:
            return None
        i, j = np.concatenate(left + right), np.concatenate(right + left)
        order = _ranks(words, np.unique(i))
        best = np.lexsort((order[j], -n[j], i))
        i, j = i[best], j[best]
        rows, first, near = np.unique(i, return_index=True, return_counts=True)
        return rows, near, n[j[first]], j[first]

    @staticmethod
    def _block(symbols, ends, rows, length):
        """Symbols of words of one length as a matrix, and how often each symbol comes in each."""
        text = symbols[(ends[rows] - length)[:, None] + np.arange(length)].astype(np.uint8).reshape(len(rows), length)
        codes = (np.arange(len(rows))[:, None] * SYMBOLS + text).ravel()
        counts = np.bincount(codes, minlength=len(rows) * SYMBOLS).reshape(len(rows), SYMBOLS)
        # Products and sums stay exact whole numbers.
        return text, counts.astype(np.float32 if length < 1_000 else np.float64)

    @staticmethod
    def _pairs(a, a_rows, b, b_rows, distance, cell, side, cross):
        """Rows of words whose letter counts have this squared distance, tile by tile."""
        twice = a is b
        a_size, b_size = (a[1] * a[1]).sum(axis=1), (b[1] * b[1]).sum(axis=1)
        several = len(a_rows) and len(b_rows) and (cell[a_rows[0]] != cell[a_rows[-1]] or cell[b_rows[0]] != cell[b_rows[-1]] or cell[a_rows[0]] != cell[b_rows[0]])
        for x in range(0, len(a_rows), TILE):
            for y in range(x if twice else 0, len(b_rows), TILE):
                rows, columns = a_rows[x : x + TILE], b_rows[y : y + TILE]
                if several and (cell[rows[-1]] < cell[columns[0]] or cell[columns[-1]] < cell[rows[0]]):
                    continue
                product = a[1][x : x + TILE] @ b[1][y : y + TILE].T
                product *= -2
                product += a_size[x : x + TILE, None]
                product += b_size[y : y + TILE]
                hit = product == distance
                i, j = np.divmod(np.flatnonzero(hit), len(columns))
                i, j = rows[i], columns[j]
                good = cell[i] == cell[j]
                if cross:
                    good &= side[i] != side[j]
                if twice:
                    good &= i < j
                if good.any():
                    yield i[good], j[good]

    @staticmethod
    def _slices(count, length):
        step = max(1, (16 << 20) // length)
        return (slice(at, at + step) for at in range(0, count, step))

    def _keep(self, left, right, i, j, a_counts, b_counts, choice):
        mine = self.parts.first_choice(a_counts, b_counts) == choice[i]
        left.append(i[mine])
        right.append(j[mine])


def _ranks(words: list[str], rows: np.ndarray) -> np.ndarray:
    """For each row, its word's place in code-point order among `rows`."""
    out = np.zeros(len(words), np.int64)
    out[sorted(rows.tolist(), key=words.__getitem__)] = np.arange(len(rows))
    return out


def near_words(words: DataFrame, scratch: Scratch, parts: int | None = None) -> DataFrame:
    """`word`, `n_near`, `best_n`, `best_word` (the near word of largest `n`, the smallest of ties) for words with any.

    `words`: `word` (distinct, of the letters above in lower case) and `n`. Words are compared where they agree in the
    counts of all letters outside two of `parts` sets, so work follows the words that are alike; more sets make smaller
    groups and more of them, and change no result. Groups of any size are cut into blocks of a bounded size, and
    each two blocks are one cell.
    """
    spark = words.sparkSession
    total = words.count()
    tool = LetterParts(parts or max(4, math.ceil(math.log10(max(total, 1))) - 2))

    def keyed(batches):
        gc.disable()
        for batch in batches:
            held, n = batch.column("word").to_pylist(), batch.column("n")
            if held:
                for k, key in enumerate(tool.keys(held)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(held), k, np.int32)), pa.array(key), batch.column("word"), n], ["k", "key", "word", "n"]
                    )

    width = shuffle_width(spark, total * len(tool.choices) * 64)
    entries = words.select("word", "n").mapInArrow(keyed, "k int, key long, word string, n long")
    sizes = entries.groupBy("k", "key").agg(F.count("*").alias("_rows"), F.sum(F.length("word")).alias("_letters")).where("_rows > 1")
    blocks = F.greatest(F.ceil(F.col("_rows") / CELL_WORDS), F.ceil(F.col("_letters") / CELL_LETTERS)).cast("int")
    member = F.pmod(F.xxhash64("word"), F.col("_blocks")).cast("int")
    cells = (
        entries.join(sizes.select("k", "key", blocks.alias("_blocks")), ["k", "key"])
        .withColumn("_own", member)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(
            "k",
            "key",
            F.least("_own", "_other").alias("low"),
            F.greatest("_own", "_other").alias("high"),
            (F.col("_own") > F.col("_other")).alias("side"),
            "word",
            "n",
        )
    )
    place = ["k", "key", "low", "high"]
    ordered = cells.repartition(width, *place).sortWithinPartitions(*place)

    def compare(batches):
        gc.disable()
        near = Near(tool)
        for table, crossing in _whole_cells(batches, place):
            held = table.column("word").to_pylist()
            n = table.column("n").to_numpy()
            found = near(held, n, table.column("_cell").to_numpy(), table.column("k").to_numpy(), table.column("side").to_numpy(), crossing)
            if found:
                rows, count, best_n, best = found
                names = table.column("word").combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(rows)), pa.array(count), pa.array(best_n), names.take(pa.array(best))],
                    ["word", "n_near", "best_n", "best_word"],
                )

    found = ordered.mapInArrow(compare, "word string, n_near long, best_n long, best_word string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best_word").alias("word"))).alias("_best")
    summed = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return scratch.save(
        summed.select("word", "n_near", (-F.col("_best.n")).alias("best_n"), F.col("_best.word").alias("best_word")), "near"
    )


def _whole_cells(batches, place: list[str]):
    """Tables of whole cells with a cell number: one cell across two blocks, or cells that together have some rows."""
    held, rows, told = [], 0, 0
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in place]
        changed = np.zeros(batch.num_rows, bool)
        changed[0] = last is None or tuple(int(c[0]) for c in columns) != last
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        crossing = columns[2] != columns[3]
        starts = np.append(np.flatnonzero(changed), batch.num_rows)
        batch = pa.Table.from_batches([batch]).append_column("_cell", pa.array(told + np.cumsum(changed)))
        told += int(changed.sum())
        if not changed[0]:
            # The rest of a cell that the batch before began.
            held.append(batch.slice(0, starts[0]))
            rows += int(starts[0])
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if held and (rows >= TILE or crossing[a] or held_crossing):
                yield pa.concat_tables(held), held_crossing
                held, rows = [], 0
            held.append(batch.slice(a, b - a))
            held_crossing = bool(crossing[a])
            rows += b - a
        last = tuple(int(c[-1]) for c in columns)
    if held:
        yield pa.concat_tables(held), held_crossing


def spelling_groups(
    df: DataFrame,
    least_letters: int = 7,
    least_n: int = 2,
    times: int = 10,
    spoilt: int = 31,
    parts: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Words of whole texts with the common form each belongs to: `word`, `form`, `root`, `n`, `n_near`, `form_n`.

    Words are the spellings (`spelled`) of at least `least_letters` code points that come `least_n` times. Two are near if
    one inserted, deleted or replaced code point parts them. `form` is the near word of largest n, of ties the smallest,
    if it comes at least `times` as often as the word, else null; `root` is where forms lead in the end, the word itself if
    it has none.

    A null text has no words; a null id counts as an empty one in the spelling; repeated rows and ids all count; an empty
    table, or one without such words, gives no rows; other columns are ignored.
    """
    scratch = Scratch(df.sparkSession)
    words = scratch.save(count_words(df, least_letters, spoilt, id_col, text_col).where(F.col("n") >= least_n), "words")
    near = near_words(words, scratch, parts)
    formed = F.col("best_n") >= times * F.col("n")
    told = scratch.save(
        words.join(near, "word", "left").select(
            "word",
            F.when(formed, F.col("best_word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(formed, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _follow(told, words, scratch, least_n, times)
    return told.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _follow(told: DataFrame, words: DataFrame, scratch: Scratch, least_n: int, times: int) -> DataFrame:
    """`word`, `root` of words with a form: each step goes as far again as all before it together."""
    roots = told.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # Along forms n grows `times` a step, which bounds the steps.
    most = words.agg(F.max("n")).first()[0] or least_n
    steps = math.log(max(most / least_n, 1)) / math.log(times) if times > 1 else math.inf
    reach = 1
    while reach < steps:
        roots = scratch.save(roots, "roots")
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        following: Column = F.coalesce("_next", "root")
        roots = roots.join(onward, "root", "left").select("word", following.alias("root"))
        reach *= 2
    return roots
