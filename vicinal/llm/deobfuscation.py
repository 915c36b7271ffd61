"""Restoring disguised words: a lattice of what each sign may stand for, decoded under a character model."""

from __future__ import annotations

import hashlib
import re

import numpy as np

from vicinal.llm.common import WHITE

# The letters that signs commonly stand for.
STANDS_FOR = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "il",
    "|": "il",
    "+": "t",
    "€": "e",
    "£": "l",
    "¡": "i",
    "(": "c",
    "<": "c",
}
ANY_LETTER = "*#%"
SEPARATORS = " .-_~'’·,​‌‍­/\\:;=^"
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(p) for p in range(0xDF, 0x100) if chr(p).isalpha())
#: Symbol 0 is the edge of a word, the last one any letter not in LETTERS.
SYMBOLS = len(LETTERS) + 2
_NUMBER = {c: i + 1 for i, c in enumerate(LETTERS)}

# Log-probabilities of the channel: what a writer who disguises a word does to one letter.
SUBSTITUTE, HIDE, REPEAT, SEPARATE, KEEP_SIGN = -2.0, -5.0, -0.7, -1.0, -9.0

WORD = re.compile(r"[^\W\d_]+")
_SIGNS = re.escape("".join(STANDS_FOR) + ANY_LETTER)
_PIECE = rf"(?:[^\W_]|[{_SIGNS}])"
_APART = f"[{re.escape(SEPARATORS)}{WHITE}]"
#: What the lattice may read in another way: a sign, a doubled letter, or characters parted by separators.
DISGUISED = re.compile(rf"[{_SIGNS}]|([^\W\d_])\1|[^\W_][{re.escape(SEPARATORS)}]+[^\W_]")
#: Pieces of one or two characters, signs among them, apart from each other.
SPACED = re.compile(rf"(?<!{_PIECE}){_PIECE}{{1,2}}(?:{_APART}+{_PIECE}{{1,2}})+(?!{_PIECE})")
#: Single characters among them, which shows where a word written apart begins.
SINGLE = re.compile(rf"(?<!{_PIECE}){_PIECE}(?:{_APART}+{_PIECE}){{2,}}(?!{_PIECE})")
PARTED = re.compile(f"{_APART}+")
#: Something that says which letters are meant; signs for any letter alone say nothing.
TELLING = re.compile(rf"[^\W_]|[{re.escape("".join(STANDS_FOR))}]")
# Pieces, runs and stretches a Python worker remembers.
RUNS_HELD = STRETCHES_HELD = 200_000

def may_begin(openings) -> re.Pattern:
    """A pattern found in every piece that the lattice can read as a word with one of these beginnings, and in some others.

    A letter is written as itself or as a sign; between letters there may be separators, signs for any letter, and
    repeats of the sign before.
    """
    tree: dict = {}
    for opening in openings:
        node = tree
        for letter in opening:
            node = node.setdefault(letter, {})

    def pattern(node: dict) -> str:
        branches = []
        for letter, rest in sorted(node.items()):
            written = letter + "".join(sign for sign, letters in STANDS_FOR.items() if letter in letters)
            branch = f"[{re.escape(written + ANY_LETTER)}]"
            if rest:
                branch += f"[{re.escape(written + ANY_LETTER + SEPARATORS)}]*{pattern(rest)}"
            branches.append(branch)
        return f"(?:{'|'.join(branches)})" if branches else "(?!)"

    return re.compile(pattern(tree))


class LetterCounts:
    """Counts of three letters in a row in words of any text, as codes."""

    def __init__(self, _=None):
        # What can't be lower-cased to one letter is no letter here.
        self.symbol = np.zeros(0x110000, np.int64)
        for point in range(0x34000):
            c = chr(point).lower()
            if len(c) == 1 and c.isalpha():
                self.symbol[point] = _NUMBER.get(c, SYMBOLS - 1)

    def __call__(self, texts: list[str]) -> np.ndarray:
        points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
        s = self.symbol[points]
        # Two edges between words: one that ends a word, one that begins the next.
        inside = (s > 0) | np.append(True, s[:-1] > 0)
        s = s[inside]
        before, two_before = np.append(0, s[:-1]), np.append([0, 0], s[:-2])
        two_before = np.where(before == 0, 0, two_before)
        return np.bincount((two_before * SYMBOLS + before) * SYMBOLS + s, minlength=SYMBOLS**3)


class Deobfuscator:
    """Viterbi decoding of one disguised word, or of letters written apart, under trigram counts.

    A state is the last two symbols. After two different letters that can only be themselves there is one state, so a text falls
    into stretches between such places, each decoded by itself: words that end alike in the same signs share the work.
    """

    def __init__(self, counts: np.ndarray):
        three = np.asarray(counts, float).reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 0.5) / (one.sum() + 0.5 * SYMBOLS)
        p2 = (two + 4 * p1) / (two.sum(axis=1, keepdims=True) + 4)
        p3 = (three + 4 * p2) / (three.sum(axis=2, keepdims=True) + 4)
        self.table = np.log(p3)
        self.stretches: dict[tuple, str] = {}
        self.pieces: dict[str, list[str]] = {}
        self.runs: dict[str, list[str]] = {}

    @staticmethod
    def arcs(text: str, i: int, spaced: bool, skip: bool) -> tuple[list[tuple[int, str, float]], float | None, float | None]:
        """What the character at i may be: letters (symbol, letter, cost); the cost of nothing; the cost of an edge."""
        c = text[i]
        if c in _NUMBER or c.isalpha():
            again = None
            if i and text[i - 1] == c:
                again = REPEAT if i > 1 and text[i - 2] == c else 3 * REPEAT
            return [(_NUMBER.get(c, SYMBOLS - 1), c, 0.0)], again, None
        letters = [(_NUMBER[letter], letter, SUBSTITUTE) for letter in STANDS_FOR.get(c, "")]
        nothing = edge = None
        if c in ANY_LETTER:
            letters = [(_NUMBER[letter], letter, SUBSTITUTE - float(np.log(26))) for letter in LETTERS[:26]]
        if c in SEPARATORS or (c in ANY_LETTER and skip) or c.isspace():
            nothing = SEPARATE
            if spaced or c not in ANY_LETTER:
                edge = SEPARATE
        if i and text[i - 1] == c and c in STANDS_FOR:
            nothing = REPEAT if nothing is None else max(nothing, REPEAT)
        if not letters and nothing is None:
            edge = KEEP_SIGN
        return letters, nothing, edge

    def _stretch(self, first: tuple[int, int], text: str, at: int, spaced: bool, skip: bool, last: bool) -> str:
        """The likeliest reading of text[at:] from the state `first`; `last`: the text ends there, and with it a word."""
        score, heads, tails = np.full((SYMBOLS, SYMBOLS), -np.inf), np.array(first[:1]), np.array(first[1:])
        score[first] = 0.0
        steps = []
        for i in range(at, len(text)):
            letters, nothing, edge = self.arcs(text, i, spaced, skip)
            live = heads[:, None], tails
            here = score[live]
            new, back = np.full((SYMBOLS, SYMBOLS), -np.inf), np.full((SYMBOLS, SYMBOLS), -1)
            symbols = np.array([s for s, _, _ in letters], np.int64)
            if letters:
                cost = np.array([cost for _, _, cost in letters])
                totals = here[:, :, None] + self.table[heads[:, None, None], tails[:, None], symbols]
                best = totals.argmax(axis=0)
                new[tails[:, None], symbols] = totals.max(axis=0) + cost
                back[tails[:, None], symbols] = heads[best] * SYMBOLS + tails[:, None]
            # Where a letter did not win, the state stays; -2 says so.
            if nothing is not None:
                stays = here + nothing > new[live]
                new[live] = np.where(stays, here + nothing, new[live])
                back[live] = np.where(stays, -2, back[live])
            if edge is not None:
                # Between words there is nothing to end.
                ends = here + np.where(tails > 0, self.table[heads[:, None], tails, 0], 0.0)
                top = int(ends.argmax())
                if ends.flat[top] + edge > new[0, 0]:
                    new[0, 0] = ends.flat[top] + edge
                    back[0, 0] = heads[top // len(tails)] * SYMBOLS + tails[top % len(tails)]
            steps.append((back, {s: letter for s, letter, _ in letters}))
            score = new
            # States that there may be now; others among them stay impossible.
            kept = nothing is not None
            edges = [0] if edge is not None else []
            heads, tails = (
                np.unique(np.concatenate([tails if letters else [], heads if kept else [], edges])).astype(np.int64),
                np.unique(np.concatenate([symbols, tails if kept else [], edges])).astype(np.int64),
            )
        if last:
            score = score + np.where(np.arange(SYMBOLS) > 0, self.table[:, :, 0], 0.0)
        a, b = divmod(int(score.argmax()), SYMBOLS)
        out = []
        for back, letter_of in reversed(steps):
            code = int(back[a, b])
            if code == -2:
                continue
            before = divmod(code, SYMBOLS)
            if b:
                out.append(letter_of[b])
            elif before[1]:
                out.append(" ")
            a, b = before
        return "".join(reversed(out))

    def __call__(self, text: str, spaced: bool = False, skip: bool = True) -> str:
        """The likeliest plain text of a lower-case string; words of it are parted by spaces.

        Without `skip` each sign for any letter is one.
        """
        plain = [_NUMBER.get(c) or (SYMBOLS - 1 if c.isalpha() else 0) for c in text]
        n, i, state, out = len(text), 0, (0, 0), []
        while i < n:
            if plain[i] and (i == 0 or text[i] != text[i - 1]):
                # Only itself: the one state becomes another.
                state = (state[1], plain[i])
                out.append(text[i])
                i += 1
                continue
            # To the first two letters that leave one state: the first, doubled or not, is the last symbol of all states.
            end = i + 1
            while end < n and not (plain[end - 1] and plain[end] and text[end] != text[end - 1]):
                end += 1
            last = end == n
            begin = max(i - 1, 0)
            key = (state, i - begin, text[begin : end + 1], spaced, skip, last)
            if key not in self.stretches:
                if len(self.stretches) >= STRETCHES_HELD:
                    self.stretches.clear()
                self.stretches[key] = self._stretch(state, key[2], i - begin, spaced, skip, last)
            out.append(self.stretches[key])
            i = end + 1
            if not last:
                state = (plain[end - 1], plain[end])
        return "".join(out).rstrip(" ")

    def _likely(self, word: str) -> bool:
        """Whether a word's letters are likelier under the model than letters at chance."""
        a = b = 0
        total = np.log(SYMBOLS) * (len(word) + 1)
        for symbol in [*(_NUMBER.get(c, SYMBOLS - 1) for c in word), 0]:
            total += self.table[a, b, symbol]
            a, b = b, symbol
        return total > 0

    def _restored(self, run: str, spaced: bool = False, skip: bool = True) -> list[str]:
        """The words of a run; of signs and digits only those that look like words, as most are numbers."""
        if not TELLING.search(run):
            return []
        found = self(run, spaced, skip).split()
        return found if WORD.search(run) else [w for w in found if self._likely(w)]

    def words(self, chunk: str, wanted: re.Pattern | None = None) -> list[str]:
        """Lower-case words of a piece of text, disguised ones restored beside their plain parts.

        With `wanted` (see `may_begin`) pieces that can't be restored to a word that begins so may be left as they are.
        """
        folded = chunk.lower()
        found = WORD.findall(folded)
        if DISGUISED.search(folded):
            for part in folded.split():
                if part not in self.pieces:
                    if wanted is not None and not wanted.search(part):
                        continue
                    if len(self.pieces) >= RUNS_HELD:
                        self.pieces.clear()
                    self.pieces[part] = self._piece_words(part) if DISGUISED.search(part) else []
                if self.pieces[part]:
                    found += self.pieces[part]
        return found

    def _piece_words(self, part: str) -> list[str]:
        """Words of a piece without white space that are not among its plain parts."""
        core = part.strip(".,;:?\"'()[]{}<>")
        # A sign at either end may be a letter or just a sign.
        forms = {core, core.rstrip("!|+*#%$@£€"), part.strip(".,;:?\"')[]{}>")}
        restored = {w for form in forms for w in self._restored(form)}
        if core and (core[0] in ANY_LETTER or core[-1] in ANY_LETTER):
            restored.update(self._restored(core, skip=False))
        return sorted(restored.difference(WORD.findall(part)))

    def _run_words(self, run: str) -> list[str]:
        # Whether as several words or as one.
        found = {*self._restored(run, True), *self._restored(PARTED.sub("", run))}
        for m in SINGLE.finditer(run):
            if m.group() != run:
                found |= {*self._restored(m.group(), True), *self._restored(PARTED.sub("", m.group()))}
        # The pieces themselves are words of their chunks.
        return sorted(found.difference(PARTED.split(run)))

    def spaced_words(self, text: str, wanted: re.Pattern | None = None) -> list[str]:
        """Words restored from characters and pairs that the text writes apart; each distinct run is decoded once.

        `wanted` as in `words`.
        """
        found = []
        for run in SPACED.findall(text.lower()):
            run = PARTED.sub(" ", run)
            if run not in self.runs:
                if wanted is not None and not wanted.search(run):
                    continue
                if len(self.runs) >= RUNS_HELD:
                    self.runs.clear()
                self.runs[run] = self._run_words(run)
            found += self.runs[run]
        return found


def deobfuscator(counts: np.ndarray) -> Deobfuscator:
    """The last one made in this process if it was for the same counts, with all that it remembers."""
    key = hashlib.sha256(np.ascontiguousarray(counts, np.int64)).digest()
    if key not in _latest:
        _latest.clear()
        _latest[key] = Deobfuscator(counts)
    return _latest[key]


_latest: dict[bytes, Deobfuscator] = {}
