"""Classifiers: held-out accuracy, awkward rows, disguised words."""

import zlib

import numpy as np
import pytest

from vicinal.llm.boosting import fit
from vicinal.llm.deobfuscation import Deobfuscator, LetterCounts
from vicinal.llm.language import fit_languages, identify
from vicinal.llm.quality import Statistics, fit_quality, score_quality
from vicinal.llm.toxicity import Evidence, drop_toxic, fit_toxicity, score_toxicity


def held_out_accuracy(scored, truth, label):
    both = scored.join(truth.select("doc_id", label), "doc_id").where("held_out").toPandas()
    mine = both["lang_pred"] if label == "lang" else both["predicted"]
    return float((mine == both[label]).mean()), len(both)


def folds(scored, modulus, held_out):
    for r in scored.collect():
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % modulus == held_out)
        assert 0 <= r.score <= 1


@pytest.fixture(scope="module")
def toxic_model(documents, labels):
    return fit_toxicity(documents, labels)


def test_quality(documents, labels, awkward, nothing):
    model = fit_quality(documents, labels)
    accuracy, n = held_out_accuracy(score_quality(documents, model), labels, "quality")
    assert n > 40 and accuracy > 0.95
    scored = score_quality(awkward, model)
    assert scored.count() == awkward.count() and score_quality(nothing, model).count() == 0
    folds(scored, 5, 0)
    unlearned = score_quality(awkward, fit_quality(nothing, labels.where("false")))
    assert {r.score for r in unlearned.collect()} == {0.5}


def test_statistics_of_any_text():
    statistics = Statistics()
    for text in ("", " ", "\n\n", "a", "!!", "A B. c\n\n", "🙂" * 10, "x" * 100_000):
        assert len(statistics(text)) == len(Statistics.names) and np.isfinite(statistics(text)).all()


def test_trees_learn_an_interaction():
    x = np.random.default_rng(0).random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.98
    assert fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert fit(x[:9], np.ones(9)).score(x[:1])[0] > 0.9


def test_language(documents, awkward, nothing):
    model = fit_languages(documents)
    accuracy, n = held_out_accuracy(identify(documents, model), documents, "lang")
    assert n > 200 and accuracy > 0.97
    scored = identify(awkward, model)
    folds(scored, 4, 2)
    for r in scored.join(awkward.select("doc_id", "text"), "doc_id").collect():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert identify(nothing, model).count() == 0
    assert {r.lang_pred for r in identify(awkward, fit_languages(nothing)).collect()} == {"und"}


def test_toxicity(documents, labels, awkward, nothing, toxic_model):
    scored = score_toxicity(documents, toxic_model)
    both = scored.join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert (both.predicted == both.toxic).mean() > 0.93 and both[both.toxic == 0].predicted.sum() == 0
    awkward_scores = score_toxicity(awkward, toxic_model)
    folds(awkward_scores, 3, 1)
    assert awkward_scores.count() == awkward.count() and score_toxicity(nothing, toxic_model).count() == 0
    assert drop_toxic(awkward, toxic_model).columns == awkward.columns
    assert fit_toxicity(nothing, labels).weights == {}


def test_toxicity_sees_through_disguise(spark, documents, toxic_model):
    plain = documents.where("lang = 'en' AND length(text) BETWEEN 300 AND 900").limit(1).first().text
    worst = sorted((f for f in toxic_model.weights if f.endswith(" ")), key=toxic_model.weights.get)[-3:]
    forms = [lambda w: w, lambda w: w.replace("i", "1").replace("o", "0").replace("s", "$"), " ".join, lambda w: w[0] + w[1] * 4 + w[2:]]
    rows = [(0, plain)] + [(1 + k, plain + "\nThe " + " and ".join(f(w.strip()) for w in worst) + ".") for k, f in enumerate(forms)]
    got = {r.doc_id: r.predicted for r in score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), toxic_model).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1}


def test_restoring_words():
    words = "idiot moron stupid clown nothing this is another plain text " * 50
    restore = Deobfuscator(LetterCounts()([words]))
    assert "idiot" in restore.words("1d10t!") and "moron" in restore.words("M0R0N,")
    assert "stupid" in restore.words("stuuuupid") and "clown" in restore.words("c.l.o.w.n")
    assert "idiot" in restore.spaced_words("an i d i o t here") and restore.spaced_words("plain text") == []
    assert restore.words("plain text, 1234") == ["plain", "text"]


def test_every_form_the_lattice_knows_reaches_it():
    counts = LetterCounts()(["idiot moron stupid clown nothing this is another plain text ass hate " * 50])
    restore = Deobfuscator(counts)
    apart = ["i d ! o t", "1 d ! 0 t", "i  d  i  o  t", "i,d,i,o,t", "i/d/i/o/t", "i - d - i - o - t", "i\td\ti\to\tt"]
    for text in [*apart, "i\nd\ni\no\nt", "ii dd ii oo tt", "id io t", "an i d i o t here"]:
        assert "idiot" in restore.spaced_words(text), text
    assert "stupid" in restore.spaced_words("$ t u p i d")
    for text, word in [("iiddiioott", "idiot"), ("@$$", "ass"), ("455", "ass"), ("#@+3", "hate"), ("(lown", "clown")]:
        assert word in restore.words(text), text
    assert any(len(w) == 3 for w in restore.words("id*"))
    assert restore.words("2024 ****") == [] and restore.spaced_words("* * *") == []
    evidence = Evidence(counts, {"stupid ": 2.0, "idiot ": 2.0})
    assert evidence.split_words("so stu pid an id io t, stu") == ["stupid", "idiot"]
    assert evidence.features(["so stu pid"])[0][0] == 2.0


def all_readings(restore, text, spaced, skip):
    """Every path of the lattice with its score, one by one."""
    paths = [(0.0, (0, 0), "")]
    for i in range(len(text)):
        letters, nothing, edge = restore.arcs(text, i, spaced, skip)
        longer = []
        for score, (a, b), read in paths:
            longer += [(score + cost + restore.table[a, b, s], (b, s), read + letter) for s, letter, cost in letters]
            if nothing is not None:
                longer.append((score + nothing, (a, b), read))
            if edge is not None:
                longer.append((score + edge + (restore.table[a, b, 0] if b else 0), (0, 0), read + " " if b else read))
        paths = longer
    return [(score + (restore.table[a, b, 0] if b else 0), read) for score, (a, b), read in paths]


def test_decoder_finds_the_best_of_all_paths():
    restore = Deobfuscator(LetterCounts()(["idiot moron stupid clown nothing this is another plain text été hate " * 50]))
    rng = np.random.default_rng(5)
    texts = ["1d10t", "m0r0n!!", "s$tup", "aaab", "b**", "éé3", "x$$.", "%%a", "!", "i d ! o t", "oo!!nn", "ж0ж"]
    texts += ["".join(rng.choice(list("abiot$1*. !0é"), rng.integers(1, 7))) for _ in range(150)]
    for text in texts:
        for spaced in (False, True):
            for skip in (False, True):
                paths = all_readings(restore, text, spaced, skip)
                best = max(paths)[0]
                got = restore(text, spaced, skip)
                scores = [score for score, read in paths if read.split() == got.split()]
                assert scores and max(scores) > best - 1e-9, (text, spaced, skip, got)


def test_one_odd_word_is_not_toxic(documents, labels, toxic_model):
    """A document that repeats words by chance like a beginning of the model stays (a clean one of these did not)."""
    scored = {r.doc_id: r.score for r in score_toxicity(documents, toxic_model).collect()}
    assert scored[462] < 0.7
    clean = [r.doc_id for r in labels.where("toxic = 0").collect()]
    assert max(scored[i] for i in clean) < 0.7


def test_gate_loses_no_word(documents):
    """Pieces left undecoded could not have given a word of the model: evidence is the same without the gate."""
    texts = [r.text or "" for r in documents.select("text").limit(400).collect()]
    texts += ["iiddiioott", "stuuupiidd cl0own", "looossser", "(idiiiot)foo id!!ott", "an i d i o t", "$ t u p i d", "1 d 1 0 t", "c.l.o.w.n", "#@+3", "@$$ 455"]
    texts += ["1*d#i%0t", "st@u@p@i@d", "ii dd ii oo tt", "x i d i o t s y", "i\nd\ni\no\nt", "l*o*s*e*r", "t-r-a-5-h"]
    weights = {"idiot ": 2.0, "idio": 1.5, "stupid ": 2.0, "loser ": 1.0, "ass ": 3.0, "hate ": 1.0, "clown ": 2.0, "ellen ": 1.3, "esse ": 0.4, "trash ": 2.0}
    counts = LetterCounts()(texts)
    gated, open_ = Evidence(counts, weights), Evidence(counts, weights)
    open_.wanted = None
    got, want = gated.features(texts), open_.features(texts)
    assert np.array_equal(got, want) and (want[-17:, 0] > 0).sum() >= 12


def test_no_evidence_speaks_against():
    evidence = Evidence(LetterCounts()(["some plain words"]), {"idiot ": 2.0, "idiot": 2.0, "clown ": 1.0})
    one, twice, two, none = evidence.features(["an idiot here", "an idiot here idiot", "an idiot clown here", ""])
    assert one.tolist() == twice.tolist() and (two >= one).all() and none.tolist() == [0.0, 0.0, 0.0]
