"""Steps on small tables do not take as many tasks and files as the session has shuffle partitions."""

from __future__ import annotations

import pytest

from prepforge.llm import neardup, quality, shared, supervised

from .test_all_labels import _many
from .test_stuck import near_copies


@pytest.fixture
def many_partitions(spark):
    own = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_partitions_follow_the_rows(spark):
    df = spark.range(0, 100, 1, 40)
    assert shared.by_rows(df, 100).rdd.getNumPartitions() == shared.FEWEST
    assert shared.by_rows(df, 20 * shared.ROWS_EACH).rdd.getNumPartitions() == 20
    assert shared.by_rows(df, 1 << 40).rdd.getNumPartitions() == 40


def test_components_of_few_links(spark, many_partitions):
    chain = [(i + 1, i) for i in range(50)]
    out = neardup.components(spark.createDataFrame(chain, "a long, b long"))
    assert {(r.node, r.label) for r in out.collect()} == {(i, 0) for i in range(51)}
    assert out.rdd.getNumPartitions() <= 2 * shared.FEWEST


def test_nodes_of_few_sets(spark, many_partitions, monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", 16)
    sketches = shared.durable(neardup.set_nodes(neardup.signatures(near_copies(spark, 80), "doc_id", "text", 5), "n_shingles", "roots", "sketch").withColumnRenamed("n_shingles", "n").coalesce(4))
    _, stuck = neardup._nodes(sketches)
    whole = neardup._whole_nodes(stuck, sketches)
    assert whole.count() and whole.rdd.getNumPartitions() <= shared.FEWEST


def test_fit_of_few_labels(spark, many_partitions, monkeypatch):
    seen = []
    fit = supervised.fit_differences
    monkeypatch.setattr(supervised, "fit_differences", lambda pairs, *rest: seen.append(pairs.rdd.getNumPartitions()) or fit(pairs, *rest))
    docs, labels = _many(spark, 500)
    assert quality.fit(docs, labels).weights.any() and seen and max(seen) <= shared.FEWEST
