"""Rows that are alike to a model are counted, and what is worked out from the counts equals what the rows give."""

from __future__ import annotations

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from prepforge.functions import metrics as mt
from prepforge.operators import models as mo
from prepforge.plans import flows, queries_models


def test_cells_of_few_values_and_scores_by_counts(spark):
    df = spark.range(900).select("id", F.pmod("id", F.lit(3)).cast("int").alias("fold"), (F.pmod(F.xxhash64("id"), F.lit(7)) < 3).cast("int").alias("label"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("few"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(800)).alias("many"))
    data = mo.binned(df, ["few", "many"])
    held = data.groupBy("cell").agg(F.count_distinct(F.coalesce("few", F.lit(-1))).alias("few"), F.max("many").alias("hi"), F.min("many").alias("lo")).collect()
    assert all(r.few == 1 for r in held) and 5 * 28 <= len(held) <= 5 * mo.BINS and max(r.hi - r.lo for r in held) < 60
    cells = mo.counted(data, "fold", "cell", "label")
    assert cells.agg(F.sum("n")).first()[0] == 900 and cells.count() < 900
    scored, models = mo.out_of_fold_cells(cells, 2, 3, lambda n: mo.boosted_classifier(depth=2, rounds=2, weight="n", total=n), "p")
    rows = mo.with_scores(data, scored, "p", "fold", "cell")
    assert len(models) == 3 and rows.count() == 900 and rows.select("id").distinct().count() == 900
    assert mt.auc(scored, "label", "p", "n").first() == mt.auc(rows, "label", "p").first()
    assert scored.agg(mt.log_loss("label", "p", n="n")).first()[0] == pytest.approx(rows.agg(mt.log_loss("label", "p")).first()[0])


def _sizes_of_training(monkeypatch) -> list[int]:
    """Numbers of rows that boosted classifiers are trained on from here on."""
    sizes, fit = [], GBTClassifier._fit
    monkeypatch.setattr(GBTClassifier, "_fit", lambda self, d: (sizes.append(d.count()), fit(self, d))[1])
    return sizes


def test_importances_train_on_counted_rows(spark, monkeypatch):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    sizes = _sizes_of_training(monkeypatch)
    most = []
    for times in (1, 3):
        copies = lines.crossJoin(spark.range(times).withColumnRenamed("id", "copy")).withColumn("l_orderkey", F.col("l_orderkey") + F.col("copy") * 10_000_000).drop("copy")
        gains = queries_models.m10_e11_importances(lambda name, copies=copies: copies)
        assert gains.count() == 15
        most.append(sum(sizes[-5:]) / copies.count())
    assert len(sizes) == 10 and most[1] < 0.9 * most[0]  # per input row


def test_credit_scores_train_on_cells_once_whatever_the_folds(spark, monkeypatch):
    """Copies add numbers to cells and no rows to train on, and each row's score is that of its fold's model."""
    names = ["a", "b"]
    df = spark.range(3000).select("id", (F.pmod(F.xxhash64("id"), F.lit(7)) < 3).cast("int").alias("label"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(60)).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("b"))
    sizes = _sizes_of_training(monkeypatch)
    got = flows.credit_oof(df, "id", "label", names, folds=5, rounds=2)
    assert got.columns == ["id", "label", "fold", "score"] and got.count() == 3000 and got.select("id").distinct().count() == 3000
    assert len(sizes) == 5 and max(sizes) <= mo.BINS * 5 * 2
    data, cells, made = flows._credit_models(df, "id", "label", names, 5, 2)
    scored = mo.out_of_fold_counts(cells, made, "p").groupBy("fold", "cell").agg(F.first("p").alias("p"))
    both = mo.scored_by_fold(data, made, 2, "q").join(data.select("id", "cell"), "id").join(scored, ["fold", "cell"])
    worst = both.agg(F.count("*").alias("n"), F.max(F.abs(F.col("p") - F.col("q"))).alias("off"), F.count_distinct("q").alias("values")).first()
    assert worst.n == 3000 and worst.off < 1e-12 and worst.values > 20
    assert cells.agg(sum((F.sum(f"n{k}") for k in range(5)), F.lit(0))).first()[0] == 3000


def test_places_in_strata_need_no_join_of_rows(spark):
    """Rows are dealt out once, with all their columns; places follow the hash of the key in each stratum, nulls included."""
    from prepforge.operators import splits as sp

    df = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"), F.when(F.col("id") % 10 > 0, F.col("id") % 3).alias("s"), (F.col("id") * 2).alias("v")).repartition(7)
    placed = sp.stratum_places(df, "key", "s", 42)
    plan = placed._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    rows = placed.withColumn("h", F.xxhash64("key", F.lit(42))).collect()
    assert len(rows) == 2000 and all(r.v == 2 * int(r.key[1:]) for r in rows)
    for s in (None, 0, 1, 2):
        own = sorted((r for r in rows if r.s == s), key=lambda r: (r.h, r.key))
        assert [r["__place"] for r in own] == list(range(len(own))) and {r["__size"] for r in own} == {len(own)}
