"""Flows and model queries: figures against limits, brute-force versions of their parts, and round trips."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepforge.functions import metrics as mt
from prepforge.operators import models as mo
from prepforge.plans import flows, registry
from prepforge.plans.queries_models import _vectors
from prepforge.plans.queries_text import _catalog
from prepforge.sources import io

registry.load()


def run(spark, sf, name):
    return registry.QUERIES[name](spark, sf)


def reader(spark, sf):
    return lambda table: spark.read.parquet(f"{sf}/{table}.parquet")


def plain_net(x, y, alpha, l1, rounds=3000):
    """Coordinate descent on the rows themselves."""
    mx, my, w = x.mean(axis=0), y.mean(), np.zeros(x.shape[1])
    x, y = x - mx, y - my
    for _ in range(rounds):
        for j in range(len(w)):
            rest = x[:, j] @ (y - x @ w + x[:, j] * w[j]) / len(y)
            w[j] = math.copysign(max(abs(rest) - alpha * l1, 0), rest) / (x[:, j] @ x[:, j] / len(y) + alpha * (1 - l1))
    return w, my - mx @ w


def test_elastic_path_equals_plain_descent(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 4)) @ rng.standard_normal((4, 4)) + 5
    y = x @ np.array([1.5, 0.0, -2.0, 0.3]) + rng.standard_normal(400) + 3
    fold = rng.integers(0, 5, 400)
    rows = [(*map(float, r), float(v), int(k)) for r, v, k in zip(x, y, fold, strict=True)] + [(None, 1.0, 1.0, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y double, fold int").repartition(5)
    alphas, l1s = [0.001, 0.05, 0.7], [0.1, 0.9]
    path = mo.elastic_path(df, ["a", "b", "c", "d"], "y", alphas=alphas, l1s=l1s)
    got = {(r.alpha, r.l1): r.rmse for r in path.scores.collect()}
    for alpha in alphas:
        for l1 in l1s:
            errors = []
            for k in range(5):
                w, b = plain_net(x[fold != k], y[fold != k], alpha, l1)
                errors.append(np.mean((y[fold == k] - x[fold == k] @ w - b) ** 2))
            assert got[alpha, l1] == pytest.approx(math.sqrt(np.mean(errors)), rel=1e-6)
    assert got[path.alpha, path.l1] == min(got.values())
    w, b = plain_net(x, y, path.alpha, path.l1)
    assert path.coefficients == pytest.approx(w, rel=1e-5, abs=1e-6) and path.intercept == pytest.approx(b, rel=1e-5)
    one = df.filter("a is not null").select(path.predict(["a", "b", "c", "d"]).alias("p"), "a").orderBy("a").first()
    assert one.p == pytest.approx(float(x[np.argmin(x[:, 0])] @ w + b), rel=1e-5)
    assert len(mo.elastic_path(df, ["a", "b"], "y").scores.collect()) == 250


def test_retraining_leaves_noisy_rows_out(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1600):
        x, junk = rng.random() * 10, rng.random()
        calm = x < 5
        rows.append((i, x, junk, float(math.floor(x) + (0 if calm else rng.standard_normal() * 6)), calm))
    df = spark.createDataFrame(rows, "id long, x double, junk double, y double, calm boolean")
    made = mo.retrain_with_pseudo(df.filter("id % 2 = 0"), df.filter("id % 2 = 1").drop("y"), ["x", "junk"], "id", "y", flows.price_makers(6), folds=3, limit=0.25)
    picked = made.pseudo.join(df, "id").agg(F.count("*").alias("n"), F.avg(F.col("calm").cast("double")).alias("calm"), F.max(F.when(F.col("calm"), F.abs(F.col("label") - F.floor("x")))).alias("off")).first()
    assert picked.n > 200 and picked.calm > 0.8
    out = made.predictions.join(df.filter("calm"), "id").agg(F.avg(F.abs(F.col("predicted") - F.floor("x"))).alias("mae"), F.count("*").alias("n")).first()
    assert out.mae < 0.5 and made.predictions.count() == 800 and "x" in made.kept


def test_slot_model_round_trip(spark, sf, tmp_path):
    events = reader(spark, sf)("events")
    flows.train_slots(events.filter("event_id % 4 > 0"), str(tmp_path / "m"), "user_id", "ts", "click", rounds=3)
    template = spark.createDataFrame([(10**9, "nobody"), (1, "known"), (2, "known"), (None, "no key")], "user_id long, note string")
    scored = [flows.score_slots(events.filter("event_id % 4 = 0"), template, str(tmp_path / "m")).collect() for _ in range(2)]
    rows = {r.user_id: r for r in scored[0]}
    assert {r.user_id: r.slots for r in scored[1]} == {k: r.slots for k, r in rows.items()} and len(scored[0]) == 4
    assert all(sorted(r.slots) == sorted(f"slot_{i}" for i in range(1, 29)) for k, r in rows.items() if k is not None)
    assert rows[10**9].note == "nobody" and rows[None].note == "no key"
    ranked = flows.slot_flow(events, "user_id", "ts", "click", folds=2, rounds=2).collect()
    assert len(ranked) > 10 and all(len(set(r.slots)) == 28 for r in ranked)
    # the model that was read back gives the scores of the one that was written
    from pyspark.ml.classification import GBTClassificationModel

    data = mo.assemble(spark.range(40).select("id", (F.col("id") % 28 + 1).alias("a"), F.col("id").alias("b"), (F.col("id") % 2).cast("int").alias("label")), ["a", "b"])
    model = mo.boosted_classifier(rounds=2).fit(data)
    io.save_model(model, str(tmp_path / "g"))
    p = [[r.p for r in mo.probability(m, data, "p").orderBy("id").collect()] for m in (model, GBTClassificationModel.load(str(tmp_path / "g")))]
    assert p[0] == p[1]


def test_catalog_to_prices(spark, sf):
    t = reader(spark, sf)
    own = _catalog(t)
    made = flows.catalog_price_flow(own.filter("sample_id % 5 > 0"), own.filter("sample_id % 5 = 0").drop("price"), _vectors(t), components=4, folds=2, rounds=2)
    price = own.select("sample_id", F.col("price").alias("true"))
    score = lambda df: df.join(price, "sample_id").agg(mt.smape("true", df.columns[-1]).alias("s"), F.count("*").alias("n")).first()
    held, known = score(made.submission.select("sample_id", "price")), score(made.oof.select("sample_id", "predicted"))
    assert held.n == own.filter("sample_id % 5 = 0").count() and known.n == own.filter("sample_id % 5 > 0").count()
    assert known.s < 6 and held.s < 6 and made.smape == pytest.approx(known.s, rel=0.05)
    assert abs(sum(made.weights.values()) - 1) < 1e-9 and made.kept
    _, parts = flows.single_split_price(made.fused.filter("split <> 'test'").drop("split"), ["words_0", "looks_0", "brand_freq"], "price", "sample_id", rounds=2)
    assert {r.split for r in parts.collect()} == {"train", "val"} and parts.filter("split = 'val'").first().smape < 8
    names = set(made.fused.columns)
    assert {"words_looks_cos", "words_0", "looks_3", "brand_freq", "words_looks_cos_by_size", "desc_len"} <= names
    assert made.fused.filter("words_0 is null").count() == 0 and made.fused.groupBy("split").count().count() == 3


def cloud(spark):
    rng = np.random.default_rng(9)
    rows = []
    for v, (w, h) in {"a": (14, 11), "b": (9, 17)}.items():
        for i in range(6 * w * h):
            x, y = rng.random() * w, rng.random() * h
            rows.append((v, i, x, y, float(10 * np.sin(x / 2) + y + rng.random())))
    return spark.createDataFrame(rows, "village string, id long, x double, y double, z double").repartition(4)


def test_villages_in_one_run_equal_single_runs(spark):
    """Two villages whose coordinates overlap, each with a grid of its own."""
    every = cloud(spark)
    both = flows.terrain_hot_spots(every, 1.0, tile=8, by=["village"])
    report = {(r.village, r.section, r.name): r.value for r in flows.terrain_report(every, 1.0, tile=8, paths=2, apart=4.0, by=["village"]).collect()}
    for v in ("a", "b"):
        own = every.filter(F.col("village") == v).drop("village")
        want = {(r.row, r.col): tuple(r)[2:] for r in flows.terrain_hot_spots(own, 1.0, tile=8).collect()}
        got = {(r.row, r.col): tuple(r)[3:] for r in both.filter(F.col("village") == v).collect()}
        assert got.keys() == want.keys()
        for at, row in want.items():
            assert got[at] == pytest.approx(row)
        single = {k[1:]: x for k, x in report.items() if k[0] == v}
        area = {c: sum(row[4 + i] for row in want.values()) / 1e4 for i, c in enumerate(("moderate_ha", "high_ha", "critical_ha"), -1)}
        assert single["points", "points"] == own.count() and 0 < single["points", "coverage_pct"] <= 100
        assert all(single["risk", c] == pytest.approx(x, abs=1e-6) for c, x in area.items())
        assert single["heights", "range"] == pytest.approx(single["heights", "high"] - single["heights", "low"])
        assert single["channels", "channels"] == 2 and single["channels", "total"] >= single["channels", "max"] >= single["channels", "mean"] >= single["channels", "min"] > 0
        assert single["checks", "range"] == float(single["heights", "range"] > 10)


def test_report_file(spark, tmp_path):
    lines = spark.createDataFrame([("a", "points", 3.0), ("a", "coverage_pct", 12.5)], "section string, name string, value double")
    io.write_report(lines, str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["[a] coverage_pct: 12.5", "[a] points: 3.0"]


def test_lines_keep_every_row(spark, sf):
    from prepforge.plans.queries_models import _lines

    li = spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_orderkey < 50")
    doubled = _lines(lambda _: li.unionByName(li))
    assert doubled.count() == 2 * li.count() == doubled.select("id").distinct().count()


def test_figures_of_model_queries(spark, sf):
    """Scores of models that learn from columns which say little lie near chance, and those of columns that say much beyond it."""
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    credit = run(spark, sf, "m04_m05_l7_credit_scores")
    assert credit.count() == n and credit.select("fold").distinct().count() == 10 and credit.filter("score between 0 and 1").count() == n
    assert 0.4 < mt.auc(credit, "label", "score").first().auc <= 1
    folds = run(spark, sf, "x04_credit_fold_scores").collect()
    assert len(folds) == 10 and all(0 <= r.auc <= 1 and r.log_loss > 0 for r in folds)
    claims = run(spark, sf, "m11_l6_claim_scores")
    assert claims.count() == n and mt.auc(claims, "label", "final").first().auc > 0.45
    final = run(spark, sf, "m07_v09_final_model")
    assert final.count() == n and mt.auc(final, "label", "p").first().auc > 0.5
    gains = run(spark, sf, "m10_e11_importances").collect()
    assert len(gains) == 15 and all(sum(r.gain for r in gains if r.fold == k) == pytest.approx(1, abs=1e-6) for k in range(5))
    assert max(gains, key=lambda r: r.gain).feature == "day"


def test_figures_of_ensemble_and_price_queries(spark, sf):
    meta = {r.model: r for r in run(spark, sf, "m12_elastic_meta").collect()}
    assert meta["meta"].mae < min(meta["a"].mae, meta["b"].mae)
    boosted = {r.model: r for r in run(spark, sf, "m13_b11_boosted_meta").collect()}
    assert boosted["meta"].smape < 15 and boosted["blend"].smape < 10
    ground = run(spark, sf, "m14_ground_classifier")
    assert mt.auc(ground, "label", "p").first().auc > 0.7
    search = run(spark, sf, "m12_elastic_search").collect()
    assert len(search) == 250 and sum(r.best for r in search) == 1 and min(search, key=lambda r: r.rmse).rmse == next(r.rmse for r in search if r.best)
    priced = run(spark, sf, "m01_m03_l2_price_flow")
    assert priced.agg(mt.smape("p_retailprice", "predicted")).first()[0] < 10
