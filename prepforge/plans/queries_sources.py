"""Queries over sources and sinks: tables are written to the shared folder by each sink and read back by its source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.durable import checkpoint_dir
from ..sources import io
from .queries_grid import _C, _cells
from .registry import query


def _folder(df) -> str:
    """A new folder beside the session's checkpoints, which driver and executors share."""
    return f"{checkpoint_dir(df.sparkSession)}/sources-{uuid.uuid4().hex}"


@query("select o_orderkey, o_orderpriority, case when o_custkey % 7 <> 0 then o_totalprice end as score from orders")
def s01_s02_csv_scan(t):
    """NaN in the file becomes null."""
    score = F.when(F.col("o_custkey") % 7 == 0, float("nan")).otherwise(F.col("o_totalprice"))
    orders = t("orders").select("o_orderkey", "o_orderpriority", score.alias("score"))
    path = _folder(orders)
    io.write_csv(orders, path)
    return io.nan_to_null(io.read_csv(orders.sparkSession, path, orders.schema))


@query("select p_partkey, p_name || ' é' as p_name from part")
def s03_csv_of_another_encoding(t):
    part = t("part").select("p_partkey", F.concat("p_name", F.lit(" é")).alias("p_name"))
    path = _folder(part)
    part.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return io.read_csv_any_encoding(part.sparkSession, path, part.schema)


@query("select o_orderkey, o_totalprice, o_orderstatus from orders")
def s04_parquet_by_status(t):
    orders = t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = _folder(orders)
    io.write_parquet(orders, path, by=["o_orderstatus"])
    return orders.sparkSession.read.parquet(path)


@query("select l_orderkey, l_linenumber, l_discount as score from lineitem")
def s05_s06_append_predictions(t):
    """Two halves, the second appended: no header comes back as a row."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("score"))
    path = _folder(rows)
    io.write_csv(rows.filter("l_linenumber <= 3"), path)
    io.write_csv(rows.filter("l_linenumber > 3"), path, mode="append")
    return io.read_csv(rows.sparkSession, path, rows.schema)


@query("select vec_id as key, unnest(range(0, 64))::int as pos, unnest(embedding)::double as value from embeddings")
def s07_vector_block(t):
    e = t("embeddings")
    path = _folder(e)
    io.write_vectors(e, path, "vec_id", "embedding")
    return io.read_vectors(e.sparkSession, path).select("key", F.posexplode("vector").alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


@query("select event_type as name, cast(count(*) as varchar) as value from events group by event_type")
def s08_run_metadata(t):
    """Counts of the event types, of which there are few, as a run's metadata."""
    counts = t("events").groupBy("event_type").count()
    spark, path = counts.sparkSession, _folder(counts)
    io.write_metadata(spark, {r.event_type: r["count"] for r in counts.collect()}, path)
    return spark.createDataFrame(list(io.read_metadata(spark, path).items()), "name string, value string")


@query("select o_orderstatus as status, cast(13 * count(*) as bigint) as bytes from orders group by o_orderstatus")
def s09_found_files(t):
    """Bytes of the files below each folder, from lines of 13 bytes; contents are not read."""
    lines = t("orders").select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("value"), F.col("o_orderstatus").alias("status"))
    path = _folder(lines)
    lines.write.partitionBy("status").text(path)
    found = io.find_files(lines.sparkSession, path, "*.txt")
    return found.groupBy(F.regexp_extract("path", "status=([^/]*)/", 1).alias("status")).agg(F.sum("length").alias("bytes"))


@query("select l_partkey::double as x, l_suppkey::double as y, l_extendedprice::double as z from lineitem")
def s10_point_table(t):
    points = t("lineitem").select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_extendedprice").alias("z"))
    path = _folder(points)
    io.write_parquet(points, path)
    return io.read_points(points.sparkSession, path)


@query(f"with {_C} select row, col, case when (row + col) % 9 <> 0 then value end as value, (select max(row) + 1 from c) as height, (select max(col) + 1 from c) as width from c")
def s11_raster(t):
    cells = _cells(t).withColumn("value", F.when((F.col("row") + F.col("col")) % 9 != 0, F.col("value")))
    meta = cells.agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    path = _folder(cells)
    io.write_raster(cells, meta, path)
    back, size = io.read_raster(cells.sparkSession, path)
    return back.select("row", "col", "value").crossJoin(F.broadcast(size))  # one row on the right


@query("select '[' || o_orderpriority || '] ' || o_orderstatus || ': ' || count(*) as value from orders group by o_orderpriority, o_orderstatus")
def s15_text_report(t):
    metrics = t("orders").groupBy(F.col("o_orderpriority").alias("section"), F.col("o_orderstatus").alias("name")).agg(F.count("*").alias("value"))
    path = _folder(metrics)
    io.write_report(metrics, path)
    return metrics.sparkSession.read.text(path)


@query("select c_custkey, c_nationkey from customer")
def s16_first_existing(t):
    customer = t("customer").select("c_custkey", "c_nationkey")
    path = _folder(customer)
    io.write_parquet(customer, f"{path}/second")
    spark = customer.sparkSession
    return spark.read.parquet(io.first_existing(spark, [f"{path}/first", f"{path}/second"]))


@query("select p_partkey, round((p_size - m) / s, 9) as p_size from part, (select avg(p_size::double) as m, stddev_pop(p_size::double) as s from part where p_partkey % 2 = 0)")
def s16_scaler_fallback(t):
    """A scaler that is fitted as no stored one is there, and another that is then read instead of being fitted on other rows."""
    from ..operators.encode import Scaler

    part = t("part").select("p_partkey", "p_size")
    path = _folder(part)
    Scaler.stored([f"{path}/old", f"{path}/new"], part.filter("p_partkey % 2 = 0"), ["p_size"])
    again = Scaler.stored([f"{path}/old", f"{path}/new"], part, ["p_size"])
    return again.transform(part).withColumn("p_size", F.round("p_size", 9))
