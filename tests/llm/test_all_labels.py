"""The trained classifiers learn from every labelled training row, however many there are."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepforge.llm import quality, shared, supervised, toxicity


def _many(spark, n):
    word = F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id"), F.lit(50)).cast("string"))
    good = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10)) >= 3
    text = F.concat_ws(" ", word, F.when(good, F.lit("fine day.")).otherwise(F.lit("SHOUT!! $$ rotter")), F.repeat(F.lit("more "), F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(9)).cast("int")))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), good.alias("good"))
    noise = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10)) == 0
    y = (F.col("good") != noise).cast("int")
    return docs.select("doc_id", "text"), docs.select("doc_id", y.alias("quality"), (1 - y).alias("toxic"))


def test_threshold_is_an_order_statistic_of_all_training_scores(spark, monkeypatch):
    docs, labels = _many(spark, 26_000)
    model = quality.fit(docs, labels)
    own = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % quality.FOLD != quality.HELD}
    assert len(own) > 16_000
    rows = quality._feature_rows(docs.select(F.col("doc_id").alias("id"), F.lit(0).alias("y"), "text")).collect()
    s = np.sort(np.array([r.x for r in rows if r.id in own]) @ model.weights)
    at = sum(y == 0 for y in own.values()) - 1
    assert model.threshold == pytest.approx((s[at - 1] + s[at + 1]) / 2, abs=1e-9)
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    again = quality.fit(docs, labels)
    assert abs(again.weights - model.weights).max() < 1e-9 and again.threshold == pytest.approx(model.threshold)


def test_counts_and_share_of_all_labels(spark):
    docs, labels = _many(spark, 22_000)
    known = supervised.labelled(labels, "toxic", toxicity.FOLD, toxicity.HELD)
    assert known.count() == sum(zlib.crc32(str(i).encode()) % toxicity.FOLD != toxicity.HELD for i in range(22_000)) > 16_000
    model = toxicity.fit(docs, labels)
    # near its optimum the mean of the fitted scores is about the share of label 1 among all training rows
    scored = toxicity.score(docs, model).join(known.withColumnRenamed("id", "doc_id"), "doc_id").agg(F.avg("score").alias("s"), F.avg("y").alias("y")).first()
    assert scored.s == pytest.approx(scored.y, abs=0.02)
