"""Exact and near duplicates of texts and vectors against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from vicinal.llm import exact_dedup as exact_module
from vicinal.llm.components import components
from vicinal.llm.embedding_dedup import Caps, embedding_links
from vicinal.llm.exact_dedup import exact_dedup
from vicinal.llm.simhash import fingerprint, links, simhash_groups
from vicinal.session import Scratch


class Union:
    def __init__(self, n):
        self.parent = list(range(n))

    def find(self, x):
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a, b):
        self.parent[self.find(a)] = self.find(b)

    def least(self, ids):
        best = {}
        for i, x in enumerate(ids):
            best[self.find(i)] = min(best.get(self.find(i), x), x)
        return [best[self.find(i)] for i in range(len(ids))]


def by_rows(frame, *names):
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


def brute_exact(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc_id, len(text or "")))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, keep, len(members), i == keep, digest) for i, _ in members]
    return sorted(out, key=repr)


EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_awkward(awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert by_rows(exact_dedup(awkward), *EXACT) == brute_exact(rows)
    assert exact_dedup(nothing).count() == 0


def test_exact_salted_groups(spark, monkeypatch):
    monkeypatch.setattr(exact_module, "LEAST_SALTED", 2)
    rows = [(i, "copy of one text" + " " * (i % 7)) for i in range(90)] + [(100 + i, f"text {i // 2}") for i in range(20)]
    assert by_rows(exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")), *EXACT) == brute_exact(rows)


def test_exact_moves_texts_once_and_stays_in_the_jvm(documents):
    plan = exact_dedup(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_print(text, words=4):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or [" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles] if tokens else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, bits):
    union, values = Union(len(ids)), np.array(prints, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= bits):
            union.join(i, i + 1 + int(j))
    return union.least(ids)


def test_simhash_of_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    prints = [brute_print(t) for _, t in rows]
    want = zip((i for i, _ in rows), (f"{p:016x}" for p in prints), brute_components([i for i, _ in rows], prints, 4), strict=True)
    assert by_rows(simhash_groups(documents), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def test_simhash_awkward(awkward, nothing):
    got = simhash_groups(awkward).collect()
    assert len(got) == awkward.count() and simhash_groups(nothing).count() == 0
    assert all(r.fingerprint == "0" * 16 and r.component_id == 3 for r in got if r.doc_id in (3, 4, 5))


@pytest.mark.parametrize("held", [1, 5, 1 << 18])
def test_fingerprint_in_parts(monkeypatch, held):
    from vicinal.llm import simhash

    monkeypatch.setattr(simhash, "WORDS_HELD", held)
    for text in ("", "one", "a b c", "A b  c D e f g a b c d", "x " * 50):
        assert fingerprint(text) == brute_print(text)


@pytest.mark.parametrize("bits", [2, 4, 7])
def test_links_of_dense_groups(spark, bits):
    rng = np.random.default_rng(bits)
    prints = set()
    for centre in rng.integers(0, 2**63, 12, dtype=np.uint64):
        for _ in range(60):
            x = int(centre)
            for b in rng.integers(0, 64, rng.integers(0, 2 * bits + 1)):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    scratch = Scratch(spark)
    edges = links(spark.createDataFrame([(x,) for x in signed], "_print long"), bits, scratch)
    assert edges.count() < 8 * len(prints)  # not all pairs
    roots = {r.node: r.root for r in components(edges, scratch).collect()}
    got = [roots.get(x, x) for x in signed]
    want = brute_components(list(range(len(prints))), prints, bits)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_components_of_paths_hubs_and_loops(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark)).collect()}
    assert len(set(got.values())) == 3 and len({got[i] for i in range(41)}) == 1 and got[200] == got[201]
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def brute_vectors(rows, least=0.9):
    good = [v is not None and i is not None and None not in v and np.isfinite(v).all() and np.any(v) for i, v in rows]
    n_links, union = [0] * len(rows), Union(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            va, vb = rows[a][1], rows[b][1]
            if good[a] and good[b] and len(va) == len(vb):
                x, y = np.array(va) / np.max(np.abs(va)), np.array(vb) / np.max(np.abs(vb))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    n_links[a] += 1
                    n_links[b] += 1
                    union.join(a, b)
    best = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            best[union.find(k)] = min(best.get(union.find(k), i), i)
    return sorted(((i, n, best.get(union.find(k))) for k, ((i, _), n) in enumerate(zip(rows, n_links, strict=True))), key=repr)


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 20))
    rows = [(k, list(map(float, centres[k % 12] + 0.32 * rng.standard_normal(20)))) for k in range(400)]
    rows += [(1000 + k, rows[3][1]) for k in range(30)] + [(2000, [2 * x for x in rows[3][1]])]
    rows += [(2001, None), (2002, [0.0] * 20), (2003, [None] + [1.0] * 19), (2004, [float("nan")] * 20), (2005, [float("inf")] * 20)]
    rows += [(2006, [1.0, 0.0]), (2007, [1.0, 0.1]), (2008, [1e300, 1e299]), (2009, [1e-300, 1e-301]), (None, [1.0, 0.0]), (2010, [])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, n_links string").repartition(3)
    got = by_rows(embedding_links(frame), "vec_id", "n_links", "component_id")
    want = brute_vectors([(i, v or None) for i, v in rows])
    found, there = sum(n for _, n, _ in got), sum(n for _, n, _ in want)
    assert all(a[0] == b[0] and a[1] <= b[1] for a, b in zip(got, want, strict=True)) and found >= 0.97 * there
    assert embedding_links(frame.where("false")).count() == 0


def test_full_filters_are_cut_into_cells(spark, monkeypatch):
    from vicinal.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 16)
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(16)
    rows = [(k, list(map(float, centre + 0.1 * rng.standard_normal(16)))) for k in range(150)]
    got = by_rows(embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "vec_id", "n_links", "component_id")
    assert got == brute_vectors(rows)


def test_filters_reach_as_far_as_planned():
    x = np.random.default_rng(7).standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.random.default_rng(8).standard_normal((300, 64))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * y / np.linalg.norm(y, axis=1, keepdims=True)
    for n in (500, 50_000):
        caps = Caps.plan(64, n, 0.9)
        met = [bool(set(a) & set(b)) for a, b in zip(caps.filters(x), caps.filters(y), strict=True)]
        assert np.mean(met) > 0.97
