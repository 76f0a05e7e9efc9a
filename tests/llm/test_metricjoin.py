"""The metric-space join against brute force, with regions of every kind."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepforge.llm import metricjoin

from .test_operators import _components
from .texts import SCHEMA, documents, table


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def corpus():
    rng = random.Random(6)
    rows = [*documents(), (3, documents()[4][1]), (5, documents()[12][1])]
    base = [f"b{i}" for i in range(300)]
    rows += [(2000 + i, edited(rng, base, rng.randrange(0, 14))) for i in range(90)]  # one group around a text, from copies to unlinked ones
    for g in range(6):  # texts that share a long common part, in groups of their own
        own = base[:150] + [f"g{g}_{i}" for i in range(150)]
        rows += [(3000 + 20 * g + i, edited(rng, own, rng.randrange(0, 5))) for i in range(12)]
    walk = list(base)  # a chain in which only neighbours are linked
    for i in rng.sample(range(40), 40):
        walk[(7 * i) % 300] = f"c{i}"
        rows.append((4000 + i, " ".join(["chain", *walk])))
    rows += [(5000 + n, " ".join(f"s{i}" for i in range(n))) for n in range(1, 40)]  # nested texts: links by size alone
    return rows


@pytest.mark.parametrize(("leaf", "pivots", "often"), [(256, 16, 8), (3, 4, 2), (8, 3, 10**6)])
def test_links_equal_brute_force(spark, monkeypatch, leaf, pivots, often):
    monkeypatch.setattr(metricjoin, "LEAF", leaf)
    monkeypatch.setattr(metricjoin, "PIVOTS", pivots)
    monkeypatch.setattr(metricjoin, "OFTEN", often)
    rows = corpus()
    got = metricjoin.jaccard_components(table(spark, rows).repartition(5), keep=("lang",))
    assert got.columns == ["doc_id", "lang", "n_shingles", "component_id"]
    have = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str)
    assert have == sorted((r[:3] for r in _components(rows, 3, 90)), key=str)


def test_pivots_separate_groups(spark, monkeypatch):
    """Regions whose sets lie in distinct groups are divided, and every linked pair stays together in some part."""
    monkeypatch.setattr(metricjoin, "LEAF", 20)
    rng = random.Random(8)
    common = [f"q{i}" for i in range(40)]
    rows = [(100 * g + i, edited(rng, common + [f"h{g}_{j}" for j in range(300)], 3)) for g in range(10) for i in range(12)]
    docs = table(spark, rows)
    one = metricjoin._signed(docs, "doc_id", "text", 3, 90, (np.zeros(0, np.uint64), np.zeros(0, np.int64)), ())
    sets = metricjoin.set_nodes(one, "n_shingles", "vector").withColumnRenamed("n_shingles", "n").withColumn("cells", F.array(F.lit(1).cast("long")))
    small, stuck = metricjoin._regions(sets, 90)  # one region of 120 sets
    parts = {}
    for r in small.collect():
        parts.setdefault(r.path, set()).add(r.node)
    assert stuck is None and max(map(len, parts.values())) <= 20
    for g in range(10):
        assert any({100 * g + i for i in range(12)} <= p for p in parts.values())


def test_count_vectors_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = np.unique(rng.integers(0, 400, 200)), np.unique(rng.integers(0, 400, 150))
        x, y = (np.minimum(np.bincount(s % metricjoin.VECTOR, minlength=metricjoin.VECTOR), 255).astype(np.uint8)[None] for s in (a, b))
        assert metricjoin.distances(x, y)[0] <= len(np.setxor1d(a, b))


def test_empty_table_and_blanks(spark):
    assert metricjoin.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    got = metricjoin.jaccard_components(table(spark, [(1, None), (2, " "), (None, "a b c"), (4, "a b c"), (3, "A b C")])).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (None, 1, None)]
