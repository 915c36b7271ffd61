"""The pipeline's stages against brute force, each on its own input."""

import pytest
from test_duplicates import brute_components, brute_exact, brute_print
from test_mixing import check

import corpus_pipeline
from vicinal.llm.mixing import mix
from vicinal.llm.toxicity import fit_toxicity, score_toxicity
from vicinal.session import Scratch

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out, scratch = spark.read.parquet(f"{SF_DIR}/documents.parquet"), [], Scratch(spark)
    for name, stage in corpus_pipeline.STAGES:
        made = scratch.save(stage(spark, docs, SF_DIR), name.replace(" ", "-"))
        out.append((docs, made))
        docs = made
    return out


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_columns_stay(steps):
    for docs, made in steps[:-1]:
        assert made.columns == docs.columns and made.subtract(docs).count() == 0


def test_toxic_documents_go(steps, labels):
    docs, made = steps[0]
    model = fit_toxicity(docs, labels)
    assert ids(made) == ids(score_toxicity(docs, model).where("predicted = 0"))
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert clean <= set(ids(made)) and len(toxic & set(ids(made))) < 0.3 * len(toxic)


def test_one_copy_stays(steps):
    docs, made = steps[1]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert ids(made) == sorted(r[0] for r in brute_exact(rows) if r[3])


def test_one_near_copy_stays(steps):
    docs, made = steps[2]
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    least = brute_components([i for i, _ in rows], [brute_print(t) for _, t in rows], 4)
    assert ids(made) == sorted(set(least))


def test_mix_is_repeated_rows(steps):
    docs, made = steps[3]
    mixed = mix(docs).collect()
    check(docs, mixed)
    assert ids(made) == sorted(r.doc_id for r in mixed for _ in range(r.epochs))


def test_every_mixed_document_is_encoded(steps):
    docs, made = steps[4]
    assert ids(made) == ids(docs)


def test_awkward_documents_go_through(spark, awkward, nothing):
    for frame in (awkward, nothing):
        docs, scratch = frame, Scratch(spark)
        for name, stage in corpus_pipeline.STAGES:
            docs = scratch.save(stage(spark, docs, SF_DIR), name.replace(" ", "-"))
        assert docs.count() >= 0
