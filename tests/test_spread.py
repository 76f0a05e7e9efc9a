"""Work on compact tables is dealt out, and equal rows of a large weight search are met first."""

import numpy as np
import pytest

from prepforge.operators import ensemble
from prepforge.operators.ranks import spread
from prepforge.plans import queries_models, queries_text


def test_parts_of_one_file_are_dealt_out(spark):
    t = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    n = spark.sparkContext.defaultParallelism
    assert t("part").rdd.getNumPartitions() == 1 < n
    catalog = queries_text._catalog(t)
    assert catalog.rdd.getNumPartitions() == n and catalog.count() == t("part").count()
    assert spread(t("part"), "p_partkey", rows=7).rdd.getNumPartitions() == -(-t("part").count() // 7)
    assert queries_models._spread_pred(t).rdd.getNumPartitions() == n


def test_large_searches_meet_equal_rows_first(spark):
    rows = [(10.0, 9.0, 12.0, 7.0), (3.0, 3.0, 2.0, 5.0), (0.0, 0.0, 0.0, 0.0), (-2.0, 1.0, -4.0, 2.0), (None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows * 50, "y double, a double, b double, c double").repartition(3)
    grid = ensemble.simplex_grid(30)
    assert len(grid) > ensemble.MANY
    found = ensemble.search_weights(df, ["a", "b", "c"], "y", grid, log=False)
    assert "keys=[y" in found._jdf.queryExecution().toString() or "keys=[c0" in found._jdf.queryExecution().toString()
    got = {(r.w_a, r.w_b): r.smape for r in found.collect()}
    x = np.array(rows[:4])
    for a, b, c in grid:
        mix, y = x[:, 1:] @ [a, b, c], x[:, 0]
        size = (np.abs(y) + np.abs(mix)) / 2
        assert got[a, b] == pytest.approx(100 * np.mean(np.where(size > 0, np.abs(y - mix) / np.where(size > 0, size, 1), 0)))
