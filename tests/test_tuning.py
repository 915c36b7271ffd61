import pytest

from vicinal import KnnConfig
from vicinal.functions.gaussian import Gaussian
from vicinal.operators.hashing import HashFamily
from vicinal.operators.tuning import (
    best_key_length,
    choose_parameters,
    default_key_length,
    default_max_comparisons,
    default_tables,
)


def test_formulas():
    assert [default_key_length(n, 64) for n in (500, 2000)] == [4, 6]
    assert default_tables(64) == 36
    assert [default_max_comparisons(n, 64, 36) for n in (500, 2000)] == [91, 104]


def test_formulas_stay_usable_at_the_edges():
    assert default_key_length(3, 64) == 1
    assert default_tables(1) == 1 and default_tables(64, factor=0.5) == 18
    assert default_max_comparisons(3, 64, 36) == 0
    assert default_max_comparisons(500, 64, 36, factor=4.0) > default_max_comparisons(500, 64, 36)


def test_given_settings_are_kept(spark):
    points = Gaussian.standard(3).sample(spark, 50, seed=1)
    config = KnnConfig(tables=7, key_length=2, max_comparisons=9, radius=0.4)
    chosen = choose_parameters(points, 50, 3, config)
    assert (chosen.tables, chosen.key_length, chosen.max_comparisons, chosen.radius) == (7, 2, 9, 0.4)


@pytest.mark.parametrize("spread", [1e-3, 1.0, 1e4])
def test_search_ends_at_any_scale_of_the_data(spark, spread):
    points = Gaussian.standard(4).sample(spark, 200, seed=1).selectExpr(
        "id", "label", f"transform(features, x -> x * {spread}D) AS features"
    )
    length, radius = best_key_length(points, HashFamily(4, default_key_length(200, 4), 1, seed=2), 0.1)
    assert length >= 1 and radius >= 0.1


def test_options_map():
    config = KnnConfig.from_options({"num_neighbors": 5.0, "num_tables": 8.0, "method": "brute"}, seed=3)
    assert (config.k, config.tables, config.method, config.radius, config.seed) == (5, 8, "brute", 0.1, 3)
    with pytest.raises(ValueError, match="unknown"):
        KnnConfig.from_options({"k": 1})


@pytest.mark.parametrize("bad", [{"k": 0}, {"radius": 0.0}, {"radius": -1.0}, {"method": "other"}, {"factor": 0.0}])
def test_bad_settings_are_refused(bad):
    with pytest.raises(ValueError):
        KnnConfig(**bad)
