"""Tables of texts kept as compressed fragments in the shared checkpoint folder, and messages between fragments and hash buckets.

A fragment is one row that holds a few megabytes of whole rows. Operators that need several looks at every text write the fragments
once, partitioned by fragment id; later looks read them there and shuffle only hashes (to buckets) and bits (back to fragments).
Every task holds one fragment or one bucket at a time; the number of buckets grows with the number of fragments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared
from .textcore import U64, Words, column_bytes, parts

FRAGMENT_BYTES = 3 << 20
MIN_BUCKETS = 64


def to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_bytes(body: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.py_buffer(body)) as reader:
        table = reader.read_all().combine_chunks()
    batches = table.to_batches()
    return batches[0] if batches else pa.RecordBatch.from_pylist([], schema=table.schema)


class Fragments:
    """df: one row for each fragment (frag long, n_rows int, body binary), durable and partitioned by frag."""

    def __init__(self, docs: DataFrame, columns: list[str], text: str = "text", fragment_bytes: int = FRAGMENT_BYTES):
        spark = docs.sparkSession
        shared.tune(spark)
        self.columns, self.text = list(columns), text
        at = self.columns.index(text)

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base, k, held, size = shared.partition_id() << 32, 0, [], 0

            def flush() -> pa.RecordBatch:
                one = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                return pa.RecordBatch.from_pydict({"frag": pa.array([base + k], pa.int64()), "n_rows": pa.array([one.num_rows], pa.int32()), "body": pa.array([to_bytes(one)], pa.binary())})

            for batch in batches:
                if not batch.num_rows:
                    continue
                _, off = column_bytes(batch.column(at))
                for lo, hi in parts(off, fragment_bytes // 4):
                    held.append(batch.slice(lo, hi - lo))
                    size += int(off[hi] - off[lo]) + 64 * (hi - lo)
                    if size >= fragment_bytes:
                        yield flush()
                        k, held, size = k + 1, [], 0
            if held:
                yield flush()

        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        raw = shared.pick(docs, *self.columns).mapInArrow(packed, "frag long, n_rows int, body binary")
        # an adaptive plan doesn't tell how its rows lie, and each look would shuffle all texts again
        adaptive = spark.conf.get("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            self.df = shared.durable(raw.repartition(n, "frag"))
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        self.n = self.df.count()
        self.buckets = max(MIN_BUCKETS, self.n // 4)

    def schema(self, docs: DataFrame, extra: str = "") -> str:
        kinds = dict(docs.dtypes)
        return ", ".join(f"`{c}` {kinds[c]}" for c in self.columns) + (f", {extra}" if extra else "")

    def map(self, f: Callable[[int, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """f for every fragment."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for frag, body in zip(batch.column("frag").to_pylist(), batch.column("body"), strict=True):
                    yield from f(frag, from_bytes(body.as_py()))

        return self.df.mapInArrow(run, schema)

    def with_replies(self, replies: DataFrame, f: Callable[[int, pa.RecordBatch, pa.Table], pa.Table], schema: str) -> DataFrame:
        """f for every fragment with the replies that carry its id (a table of no rows, if none)."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return f(left.column("frag")[0].as_py(), from_bytes(left.column("body")[0].as_py()), right)

        known = self.df.groupBy("frag").cogroup(replies.groupBy("frag"))
        return known.applyInArrow(run, schema)


def words_of(batch: pa.RecordBatch, text: str, separators: np.ndarray, lower: bool, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their rows, and the number of words of each row, worked out a megabyte at a time."""
    data, off = column_bytes(batch.column(batch.schema.get_field_index(text)))
    h, rows, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in parts(off, 1 << 20):
        w = Words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], separators, lower)
        h.append(w.hashes(seed))
        rows.append(w.rows + lo)
        counts.append(w.counts)
    return np.concatenate(h), np.concatenate(rows), np.concatenate(counts)


def groups_of(h: np.ndarray, tie: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts h (then tie), where each new value begins in it, and the number of the value of each sorted place."""
    order = np.argsort(h, kind="stable") if tie is None else np.lexsort((tie, h))
    s = h[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    if tie is not None:
        t = tie[order]
        first[1:] |= t[1:] != t[:-1]
    return order, np.flatnonzero(first), np.cumsum(first) - 1


def low_bytes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def from_low_bytes(blob: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that puts keys together by bucket (else in their order), the buckets that occur, and where each begins and the end."""
    b = (keys % U64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    s = b[order]
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return order, s[at], np.r_[at, len(s)]
