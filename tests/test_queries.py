"""Registered queries against DuckDB, and what holds for those that SQL cannot express."""

from __future__ import annotations

import os

import duckdb
import pytest

from prepforge.plans import registry

registry.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, float):
        return float(f"{x:.8g}")
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return x if isinstance(x, (bool, int)) else str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, sf, db, name):
    got = registry.QUERIES[name](spark, sf)
    want = db.sql(registry.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["t06_exact_sample", "e10_label_noise", "v03_k_fold", "d12_to_utm", "f18_l1_preprocess_catalog", "t04_g18_spaced_top"])
def test_same_rows_for_any_partitions(spark, sf, name):
    def once(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        out = registry.QUERIES[name](spark, sf)
        return rows(out.columns, [tuple(r) for r in out.collect()])

    try:
        a, b = once(1), once(7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b and a


def test_entry_file_lists_all(spark):
    import __spark_entry__ as entry

    known = entry.queries()
    assert set(registry.QUERIES) <= set(known) and set(entry.oracle_sql()) <= set(known)
    assert entry.entry(spark).columns == ["user_id", "slots"]
    assert os.path.exists(entry.__file__)
