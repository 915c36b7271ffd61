"""Targets and sampling against a plain calculation."""

import re

import pytest

from vicinal.llm.mixing import mix


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, budget, target = set(order), 1.5 * sum(sizes.values()), {}
    while left:
        share = {s: budget * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] >= 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2 * sizes[s]
            budget -= target[s]
        left -= over
    return target


def check(frame, got):
    words = {}
    for r in frame.collect():
        words.setdefault(r.source, []).append((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))))
    sizes = {s: sum(n for _, n in docs) for s, docs in words.items()}
    want = plain_targets(sizes)
    source_of = {r.doc_id: r.source for r in frame.collect()}
    assert len(got) == frame.count()
    for s, docs in words.items():
        mine = [r for r in got if source_of[r.doc_id] == s]
        assert sorted(((r.doc_id, r.size) for r in mine), key=repr) == sorted(docs, key=repr)
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) for r in mine)
        assert all(r.taken in (0, r.size, 2 * r.size) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(n for _, n in docs) / 2 + 1e-6


def test_documents(documents):
    got = mix(documents).collect()
    check(documents, got)
    assert sorted(got) == sorted(mix(documents.repartition(7)).collect())
    assert sorted(got) != sorted(mix(documents, seed=1).collect())


def test_awkward(spark, awkward, nothing):
    unique = awkward.dropDuplicates(["doc_id"])
    check(unique, mix(unique).collect())
    assert mix(awkward).count() == awkward.count() and mix(nothing).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r.size, r.taken) for r in mix(blank).collect()} == {(0, 0)}


def test_better_documents_are_taken_more(spark):
    rows = [(i, ("word " * 20 if i % 2 else "%$#& " * 20), "bad" if i < 2000 else "zzz") for i in range(4000)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1.0, 9.0), share=0.75).collect()
    once = [r for r in got if r.doc_id < 2000]
    taken = {odd: sum(r.taken for r in once if r.doc_id % 2 == odd) for odd in (0, 1)}
    assert taken[1] > 2 * taken[0]
