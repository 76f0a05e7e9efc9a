"""Retraining meets equal rows once, with their number, and predicts every row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from prepforge.operators import models as mo
from prepforge.plans import flows


def test_equal_rows_are_met_once(spark):
    seen = []

    class Counting:
        def __init__(self, model):
            self.model = model

        def __getattr__(self, name):
            return getattr(self.model, name)

        def fit(self, train):
            seen.append((train.count(), train.agg(F.sum("weight")).first()[0]))
            return self.model.fit(train)

    mo_least = mo.least_by_weight
    makers = {n: (lambda w=None, make=make: make(w)) for n, make in flows.price_makers(3).items()}
    x = F.pmod(F.floor(F.col("id") / 2), F.lit(8)).cast("double")
    df = spark.range(2000).select("id", F.when(x < 7, x).alias("x"), (F.col("id") % 3).cast("double").alias("z"), F.coalesce(x, F.lit(0.0)).alias("y"))
    mo.least_by_weight = lambda m, total: Counting(mo_least(m, total))
    try:
        made = mo.retrain_with_pseudo(df.filter("id % 2 = 0"), df.filter("id % 2 = 1").drop("y"), ["x", "z"], "id", "y", makers, folds=2, limit=0.5)
    finally:
        mo.least_by_weight = mo_least
    assert len(seen) == 9 and max(n for n, _ in seen) <= 2 * 8 * 3
    pseudo = made.pseudo.count()
    assert sum(w for _, w in seen[:2]) == pytest.approx(1000) and seen[-1][1] == pytest.approx(1000 + 0.5 * pseudo)
    out = made.predictions.join(df, "id")
    assert made.predictions.count() == out.count() == 1000 and made.predictions.select("id").distinct().count() == 1000
    assert 0 < pseudo == made.pseudo.filter("id % 2 = 1").distinct().count()
    means = {r.x: r.p for r in out.groupBy("x").agg(F.avg("predicted").alias("p")).collect()}
    assert means[6.0] > means[1.0] + 1


def test_rows_meet_their_predictions_in_one_join(spark):
    """What rows are given is put together for different features first: predictions and pseudo-labels of all rows are one join, and neither is joined by key."""
    x = F.pmod("id", F.lit(8)).cast("double")
    df = spark.range(1200).select("id", x.alias("x"), (F.col("id") % 3).cast("double").alias("z"), x.alias("y"))
    made = mo.retrain_with_pseudo(df.filter("id % 5 < 2"), df.filter("id % 5 >= 2").drop("y"), ["x", "z"], "id", "y", flows.price_makers(2), folds=2, limit=0.5)
    plan = made.predictions._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    given = made.predictions.filter("agreed is not null")
    assert 0 < given.count() == made.pseudo.count() == made.pseudo.join(given.select("id", "agreed"), "id").filter("label = agreed").count()
    assert made.predictions.count() == 720
