"""Rows of groups that branches do not separate are made once, and read as they were written."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np

from prepforge.llm import metricjoin, neardup, shared

from .test_metricjoin import edited
from .texts import table


def near_copies(spark, n: int):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(300)]
    return table(spark, [(i, edited(rng, base, 1 + i % 3)) for i in range(n)])


def joins(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi")


def test_inseparable_nodes_are_read_back(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", 16)
    sketches = shared.durable(neardup.set_nodes(neardup.signatures(near_copies(spark, 80), "doc_id", "text", 5), "n_shingles", "roots", "sketch").withColumnRenamed("n_shingles", "n"))
    _, stuck = neardup._nodes(sketches)
    n = sketches.count()
    assert n < stuck.count() <= neardup.TREES * n and joins(stuck) == 0


def test_inseparable_regions_are_read_back(spark, monkeypatch):
    monkeypatch.setattr(metricjoin, "LEAF", 16)
    docs = near_copies(spark, 80)
    often = metricjoin.frequent(docs, "text", 3)
    sets = shared.durable(neardup.set_nodes(metricjoin._signed(docs, "doc_id", "text", 3, 90, often, ()), "n_shingles", "cells", "vector").withColumnRenamed("n_shingles", "n"))
    _, stuck = metricjoin._regions(sets, 90)
    assert stuck.count() and joins(stuck) == 0


def test_pairs_of_a_group_are_listed_in_parts():
    n = 1500  # texts of one unit that all share their tokens: 1.1 million pairs
    tokens, rows = np.tile(np.arange(20, dtype=np.uint64), n), np.repeat(np.arange(n), 20)
    unit, right = np.zeros(n, np.int64), np.zeros(n, bool)
    tracemalloc.start()
    seen = sum(int((both == 20).sum()) for _, _, both in neardup.token_pairs(tokens, rows, unit, right))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n * (n - 1) // 2 and most < 60e6  # a list of all pairs alone takes 45 MB, and its steps several times that
