"""Near words and forms against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from vicinal.llm import spelling
from vicinal.llm.queries import op11_spelling
from vicinal.llm.spelling import LetterParts, spelled, spelling_groups


def brute(rows, least=7):
    """Every word, form, root, n, n_near and form_n by neighbours written out."""
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 2}
    near, replaced = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            replaced[w[:k] + "?" + w[k + 1 :]].add(w)
            shorter = w[:k] + w[k + 1 :]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in replaced.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def got(frame):
    rows = frame.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_whole_table(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    found = got(op11_spelling(spark, "/root/testdata/sf0.01"))
    assert found == brute(rows) and any(form for _, form, *_ in found)


@pytest.fixture(scope="module")
def chains(spark):
    """Words whose forms lead on, ties of the largest near word, near words of every kind, capitals and accents."""
    words = {"abcdefgh": 2500, "abcdefgx": 240, "abcdefyx": 21, "abcdezyx": 2, "bbcdefgh": 2500, "abcdefghi": 2, "bcdefgh": 3}
    words |= {"élèveÀß": 40, "éléveÀß": 3, "ELEVATOR": 60, "elevatör": 4, "aaaaaaaa": 30, "aaaaaaa": 3, "listens": 5, "silents": 5}
    words |= {"x" * 5000: 50, "x" * 4999 + "y": 4, "onlyonce": 1, "short": 99}
    rows, i = [], 0
    for word, n in words.items():
        for _ in range(n):
            i += 1
            rows.append((i, f"1{word}2" if i % 2 else f"{word}. {word[:3]}"))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("parts", [None, 5, 7])
def test_chains_and_ties(spark, chains, parts):
    found = got(spelling_groups(chains, parts=parts))
    assert found == brute([(r.doc_id, r.text) for r in chains.collect()])
    by_word = {w: rest for w, *rest in found}
    assert by_word["abcdezyx"][1] == "abcdefgh" or by_word["abcdefyx"][1] == "abcdefgh"


def test_groups_cut_into_blocks(spark, documents, monkeypatch):
    """Small cells give the same rows: groups are then compared block by block."""
    some = documents.where("lang = 'en'")
    whole = got(spelling_groups(some))
    monkeypatch.setattr(spelling, "CELL_WORDS", 3)
    assert got(spelling_groups(some)) == whole


def test_a_word_in_a_third_of_all_places(spark):
    rows = [(i, "common1 commonly common " + ("commonly" if i % 3 else "commonli")) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(spelling_groups(frame)) == brute(rows)


def test_awkward_rows(awkward, nothing):
    assert got(spelling_groups(awkward)) == brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert spelling_groups(nothing).count() == 0
    assert spelling_groups(nothing).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelled():
    spoilt = [w for w in (f"{a}bcdefgh" for a in "abcdefghijklmnopqrstuvwxyz") if spelled(w, 1) != w]
    for w in spoilt:
        h = zlib.crc32(f"1:{w}".encode())
        assert h % 31 == 0 and spelled(w, 1) == w[: h % 8] + w[h % 8 + 1 :]
    assert spelled("ÀB", 3) in ("Àb", "À", "b")


def test_one_edit_keeps_the_hash_of_some_choice():
    tool = LetterParts(4)
    for a, b in [("abcdefg", "abcdefh"), ("abcdefg", "abcdef"), ("aaaaaaa", "zaaaaaa"), ("élève", "éleve")]:
        keys = tool.keys([a, b])
        assert (keys[:, 0] == keys[:, 1]).any()
