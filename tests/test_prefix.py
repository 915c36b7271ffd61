"""Running totals over ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.operators.prefix import running_total
from vicinal.session import Scratch
from vicinal.sources.points import assign_ids


@pytest.mark.parametrize("n", [0, 1, 500])
def test_running_total(spark, n):
    values = np.random.default_rng(0).integers(0, 9, n)
    rows = spark.createDataFrame([(f"k{i:04d}", int(v), None) for i, v in enumerate(values)], "key string, v bigint, _x int")
    scratch = Scratch(spark)
    saved = scratch.save(rows.repartition(5), "rows")
    told = running_total(saved, ["key"], F.col("v"), "before", scratch)
    assert told.columns == ["key", "v", "_x", "before"]
    got = {r.key: r.before for r in told.collect()}
    assert got == {f"k{i:04d}": int(values[:i].sum()) for i in range(n)}


def test_null_keys_and_falling_order(spark):
    rows = spark.createDataFrame([(3, 1), (None, 10), (1, 100)], "key int, v bigint")
    scratch = Scratch(spark)
    told = running_total(scratch.save(rows, "rows"), [F.col("key").isNull(), F.col("key").desc()], F.col("v"), "before", scratch)
    assert {r.key: r.before for r in told.collect()} == {3: 0, 1: 1, None: 101}


def test_no_window_over_all_rows(spark):
    ids = assign_ids(spark.range(1000).repartition(7).select(F.col("id").alias("x")))
    assert sorted(r.id for r in ids.collect()) == list(range(1000))
    assert "SinglePartition" not in ids._jdf.queryExecution().executedPlan().toString()
