"""Looks at fragments read them where they lie."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from prepforge.llm.fragments import Fragments


def test_fragments_are_not_shuffled_again(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("some text "), F.col("id").cast("string")).alias("text"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    frags = Fragments(docs, ["doc_id", "text"], fragment_bytes=4096)
    assert spark.conf.get("spark.sql.adaptive.enabled") == before
    replies = frags.df.select("frag", F.lit(1).alias("x"))
    replies = replies.repartition(3, "x")

    def count(frag, batch, told):
        return pa.table({"frag": pa.array([frag], pa.int64()), "n": pa.array([batch.num_rows * told.num_rows], pa.int64())})

    out = frags.with_replies(replies, count, "frag long, n long")
    plan = out._jdf.queryExecution().sparkPlan().toString(), out._jdf.queryExecution().executedPlan().toString()
    # one shuffle of the replies to x, one of them to the fragments, none of the fragments
    assert plan[1].count("Exchange hashpartitioning(frag") == 1, plan[1]
    assert out.agg(F.sum("n")).first()[0] == 400
