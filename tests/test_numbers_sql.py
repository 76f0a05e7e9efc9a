"""The SQL of f12_numbers beside the query, bit by bit, on numbers whose last digits show the order of a sum."""

from __future__ import annotations

import duckdb

from prepforge.plans import registry

registry.load()


def test_numbers_equal_sql_to_the_last_bit(spark, tmp_path):
    texts = [None, "", "908038 7 2669109448945250 91 730 2 64001 52934 43 9336", "83.229 25.121 3627072101032238 83.229 25.121", "1 2.5 9777946427004852 0.1 0.2 0.3", "0.001 " * 15 + "0.009", "12345678901234567890123456789012345 7", "9" * 200 + " 1"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["f12_numbers"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(registry.ORACLE["f12_numbers"]).select(", ".join(got.columns)).fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
