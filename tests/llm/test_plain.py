"""Plain versions of scores and draws, and texts of any length."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from test_mixing import check, plain_targets

from vicinal.llm.common import letter_slices
from vicinal.llm.deobfuscation import LetterCounts
from vicinal.llm.language import BUCKETS, fit_languages, identify
from vicinal.llm.mixing import mix
from vicinal.llm.queries import op10_language

WORD = 1 << 64


def plain_grams(text):
    """Buckets of all runs of one to three letters, word ends as a letter, in Python's own numbers."""
    line, seen = [0], False
    for c in text.lower():
        if c.isalpha() and ord(c) < 0x34000:
            line.append(ord(c))
            seen = True
        elif seen and line[-1]:
            line.append(0)
    if line[-1]:
        line.append(0)
    one, two, three = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    codes = [c * one for c in line if c]
    codes += [a * one + b * two for a, b in zip(line, line[1:])] if len(line) > 1 else []
    codes += [a * one + b * two + c * three for a, b, c in zip(line, line[1:], line[2:]) if b]
    out = []
    for code in codes:
        code %= WORD
        code = (code ^ (code >> 29)) * 0xBF58476D1CE4E5B9 % WORD
        out.append(code >> (64 - 15))
    return out


def test_language_is_naive_bayes(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    told = {r.doc_id: r for r in op10_language(spark, "/root/testdata/sf0.001").collect()}
    rows = [(r.doc_id, (r.text or "")[:3000], r.lang) for r in documents.collect()]
    short = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(short)
    held_out = {i: r.held_out for i, r in told.items()}
    counts, number = defaultdict(Counter), Counter()
    for i, text, lang in rows:
        if lang is not None and not held_out[i]:
            counts[lang].update(plain_grams(text))
            number[lang] += 1
    total = {lang: sum(c.values()) + 0.5 * BUCKETS for lang, c in counts.items()}
    got = {r.doc_id: r for r in identify(short, model).collect()}
    for i, text, _ in rows[:60]:
        grams = Counter(plain_grams(text))
        score = {
            lang: math.log((number[lang] + 1) / (sum(number.values()) + len(number)))
            + sum(n * math.log((counts[lang][g] + 0.5) / total[lang]) for g, n in grams.items())
            for lang in counts
        }
        best = max(score, key=score.get)
        assert got[i].lang_pred == best
        assert abs(got[i].score - 1 / sum(math.exp(s - score[best]) for s in score.values())) < 1e-3


def test_long_texts_in_parts(spark, documents):
    """A text of millions of letters is scored in parts and gives what its counts give."""
    model = fit_languages(documents)
    german = documents.where("lang = 'de' AND length(text) > 500").first().text
    rows = [(1, german * (3_000_000 // len(german))), (2, "x" * 2_500_000), (3, german)]
    got = {r.doc_id: r.lang_pred for r in identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1] == got[3] == "de" and len(got) == 3
    text = "Ein schöner Tag, heute! 3x ab" * 40
    parts = [p for _, p in letter_slices([(0, text)], 37)]
    assert "".join(parts) == text and len(parts) > 20
    assert np.array_equal(LetterCounts()([text]), LetterCounts()(parts))
    assert [p for _, p in letter_slices([(0, "")], 5)] == [""]


def test_draw_against_a_plain_one(spark, documents):
    from vicinal.llm.mixing import _measures

    work = documents.selectExpr("doc_id AS _id", "text AS _text", "source AS _source")
    measured = work.mapInArrow(_measures, "_id long, _source string, size long, _quality double")
    bits = F.shiftrightunsigned(F.xxhash64("_id", F.lit(0)), 11).alias("bits")
    rows = measured.select("_id", "_source", "size", "_quality", bits).collect()
    sizes = Counter()
    for r in rows:
        sizes[r._source] += r.size
    targets = plain_targets(dict(sizes))
    want = {}
    for source, target in targets.items():
        mine = sorted(
            (r for r in rows if r._source == source),
            key=lambda r: (-math.log((r.bits + 0.5) / 2.0**53) / r._quality, r._id),
        )
        epochs = math.floor(target / sizes[source]) if sizes[source] else 0
        rest, at, left = target - epochs * sizes[source], 0, []
        for r in mine:
            want[r._id] = epochs
            if at + r.size <= rest:
                want[r._id] += 1
            else:
                left.append((r, at))
            at += r.size
        if left:
            gap = rest - left[0][1]
            fit = min(((abs(r.size - gap), start, r._id) for r, start in left if abs(r.size - gap) < gap), default=None)
            if fit and dict((r._id, r.size) for r, _ in left)[fit[2]] > 0:
                want[fit[2]] += 1
    assert {r.doc_id: r.epochs for r in mix(documents).collect()} == want


def test_a_source_for_each_document(spark, documents):
    many = documents.withColumn("source", F.concat(F.lit("s"), F.lpad("doc_id", 6, "0")))
    got = mix(many).collect()
    check(many, got)
