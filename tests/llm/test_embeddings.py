"""Links of vectors of any length against brute force, with pairs planted at known cosines."""

import numpy as np
import pytest

from vicinal.llm.embedding_dedup import Caps, embedding_links


def planted(n, dim, near, seed=0):
    """Random directions, of which the first `near` have a partner at a cosine of 0.9 to 0.99, or a little below 0.9."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine = np.where(np.arange(near) % 4 == 0, rng.uniform(0.86, 0.895, near), rng.uniform(0.902, 0.99, near))
    away = rng.standard_normal((near, dim))
    away -= (away * x[:near]).sum(axis=1, keepdims=True) * x[:near]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    partner = cosine[:, None] * x[:near] + np.sqrt(1 - cosine**2)[:, None] * away
    return np.vstack([x, partner])


def brute_links(x, least=0.9):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    counts = np.zeros(len(x), np.int64)
    for at in range(0, len(x), 1000):
        close = unit[at : at + 1000] @ unit.T >= least
        close[np.arange(len(close)), at + np.arange(len(close))] = False
        counts += close.sum(axis=0)
    return counts


def found_links(spark, x):
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = np.zeros(len(x), np.int64)
    for r in embedding_links(frame.repartition(4)).collect():
        got[r.vec_id] = r.n_links
    return got


@pytest.mark.parametrize("dim", [3, 384, 513, 768, 4096])
def test_links_of_any_length(spark, dim):
    x = planted(500 if dim > 3 else 60, dim, 200 if dim > 3 else 20)
    want, got = brute_links(x), found_links(spark, x)
    assert (got <= want).all() and got.sum() >= 0.95 * want.sum() > 0


def test_recall_among_many_vectors(spark):
    x = planted(16_000, 64, 8_000)
    want, got = brute_links(x), found_links(spark, x)
    assert (got <= want).all() and got.sum() >= 0.95 * want.sum()


def test_more_lengths_than_anyone_counts(spark):
    """A thousand and more lengths, two vectors of each that link."""
    rng = np.random.default_rng(1)
    rows = []
    for d in range(2, 1105):
        v = rng.standard_normal(d)
        rows += [(2 * d, v.tolist()), (2 * d + 1, (3 * v + 1e-3).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = embedding_links(frame).collect()
    linked = sum(r.n_links == 1 and r.component_id == r.vec_id // 2 * 2 for r in got)
    assert len(got) == len(rows) and linked >= 0.95 * len(rows)


def test_plans_for_any_length_and_number():
    for dim in (2, 64, 512, 513, 768, 1024, 1536, 4096, 20_000):
        for n in (1, 1000, 10**9):
            caps = Caps.plan(dim, n, 0.9)
            assert caps.codes >= 2 and 0 < caps.reach < 1
