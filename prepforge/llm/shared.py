"""Spark helpers shared by the text operators: durable intermediates, size-checked filters, crc folds."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import checkpoint_dir, durable  # noqa: F401

#: A side of a join is broadcast only if its measured size is below this.
BROADCAST_BYTES = 8 << 20

#: Rows of numbers for a partition of a table of known size, and its fewest partitions.
ROWS_EACH, FEWEST = 1 << 14, 8


def tune(spark: SparkSession) -> None:
    """Keeps Arrow batches small, so that a worker's memory doesn't follow the longest texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.pythonUDF.arrow.enabled", "true")


def by_rows(df: DataFrame, n: int) -> DataFrame:
    """df in no more partitions than n, about its number of rows, asks for: in a session of many partitions each step on a small table would be as many tasks and files."""
    return df.coalesce(max(FEWEST, -(-n // ROWS_EACH)))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the caller's table cannot clash with helper columns."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def semi(df: DataFrame, ids: DataFrame, key: str, n_ids: int) -> DataFrame:
    """Rows of df whose key is in ids (one long column); ids are broadcast only if their measured size is small, else both sides are shuffled."""
    right = F.broadcast(ids) if n_ids * 16 <= BROADCAST_BYTES else ids
    return df.join(right, key, "left_semi")


def without(df: DataFrame, ids: DataFrame, key: str, n_ids: int) -> DataFrame:
    """Rows of df whose key is not in ids; broadcast as in semi."""
    right = F.broadcast(ids) if n_ids * 16 <= BROADCAST_BYTES else ids
    return df.join(right, key, "left_anti")


def crc_mod(column: str, m: int):
    """crc32 of the id as decimal text, modulo m; null ids give null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(m))


def partition_id() -> int:
    ctx = TaskContext.get()
    return ctx.partitionId() if ctx is not None else 0


def record_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def spark_schema(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.float64(): "double", pa.bool_(): "boolean"}

    def kind(t: pa.DataType) -> str:
        if pa.types.is_list(t):
            return f"array<{kind(t.value_type)}>"
        return names[t]

    return ", ".join(f"{f.name} {kind(f.type)}" for f in schema)
