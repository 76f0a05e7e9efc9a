"""Toxicity: a linear classifier on character n-grams that are scaled by naive Bayes log-count ratios.

Every text is the set of its byte n-grams (ASCII lower-cased, white space as one blank, n from ORDERS) in a hash space of fixed size. From
labelled text come, for each n-gram, the documents of either class that hold it, and from these its log-count ratio; a logistic regression
on present n-grams, each with its ratio as value, gives the weights. The KEPT n-grams whose ratios stand out most carry the model.

Fitted on all labelled training rows; all texts are scored whole.

Defined cases: null text is empty; an empty text has no n-gram and gets the intercept; without both labels in training every score is the
share of label 1 (0 without labels); rows that repeat an id count once in training, and of several labels for an id the smallest counts; an
empty table gives no rows; texts are read whole, of any length; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, supervised
from .textcore import LOWER, SPACE, column_bytes, parts

FOLD, HELD = 5, 0
ORDERS = (3, 4, 5, 6)
BITS, KEPT = 20, 6000
_BLOCKS = 64
_FOLDED = np.where(SPACE, 32, LOWER).astype(np.uint8)


def ngrams(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the hashed n-gram at every place, and whether it lies within one row."""
    b = _FOLDED[data].astype(np.uint32) + np.uint32(1)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(data))
    h = b * np.uint32(0x85EBCA6B)
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint32(0x01000193) ^ b[n - 1 :] * np.uint32(0x9E3779B1) if len(h) else h
        if n in ORDERS:
            g = h ^ (h >> np.uint32(15))
            g = (g * np.uint32(0x2C1B3C6D + 2 * n)) >> np.uint32(32 - BITS)
            yield g, left[: len(g)] >= n


def present(data: np.ndarray, off: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Row and n-gram of each distinct n-gram of each row, of all or of those wanted."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keys = [np.zeros(0, np.int64)]
    for g, inside in ngrams(data, off):
        ok = inside if wanted is None else inside & wanted[g]
        at = np.flatnonzero(ok)
        keys.append((row[at] << BITS) | g[at])
    k = np.sort(np.concatenate(keys))
    k = k[np.r_[True, k[1:] != k[:-1]]] if len(k) else k
    return k >> BITS, k & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Toxic:
    """Weight of each hashed n-gram (0 for those that are not used) and the intercept."""

    places: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.places] = self.weights
        return out


def _counts(rows: DataFrame) -> DataFrame:
    """place, p and q: labelled documents of class 1 and 0 that hold the n-gram. Tasks send sums by block of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            data, off = column_bytes(batch.column(2))
            y = batch.column(1).to_numpy()
            for lo, hi in parts(off, 1 << 19):
                r, g = present(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], None)
                label = y[lo:hi][r]
                for k in (0, 1):
                    sums[k] += np.bincount(g[label == k], minlength=1 << BITS).astype(np.int32)
        pack = zstandard.ZstdCompressor(level=1)
        cut = sums.reshape(2, _BLOCKS, -1)
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(_BLOCKS), pa.int32()), "body": pa.array([pack.compress(np.ascontiguousarray(cut[:, i]).tobytes()) for i in range(_BLOCKS)], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        unpack, block = zstandard.ZstdDecompressor(), table.column("block")[0].as_py()
        sums = np.zeros((2, (1 << BITS) // _BLOCKS), np.int64)
        for body in table.column("body"):
            sums += np.frombuffer(unpack.decompress(body.as_py()), np.int32).reshape(2, -1)
        at = np.flatnonzero(sums.sum(0) >= 4)
        return pa.table({"place": pa.array(at + block * sums.shape[1]), "p": pa.array(sums[1, at]), "q": pa.array(sums[0, at])})

    return rows.select("id", "y", "text").mapInArrow(run, "block int, body binary").groupBy("block").applyInArrow(total, "place long, p long, q long")


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", key: str = "doc_id", text: str = "text") -> Toxic:
    shared.tune(docs.sparkSession)
    known = supervised.labelled(labels, column, FOLD, HELD, key)
    own = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = shared.durable(own.join(F.broadcast(known) if supervised.is_small(known) else known, "id").dropDuplicates(["id"]))
    count = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if not count.get(0) or not count.get(1):
        seen = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
        share = seen.get(1, 0) / max(sum(seen.values()), 1)
        return Toxic(np.zeros(0, np.int64), np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    n1, n0 = count[1], count[0]
    ratio = F.log((F.col("p") + 1) / (n1 + 2)) - F.log((F.col("q") + 1) / (n0 + 2))
    strength = F.abs(ratio) / F.sqrt(1 / (F.col("p") + 1) + 1 / (F.col("q") + 1))
    top = _counts(rows).select("place", ratio.alias("r"), strength.alias("z")).orderBy(F.desc("z"), "place").limit(KEPT).collect()
    top.sort(key=lambda t: t.place)
    places, r = np.array([t.place for t in top], np.int64), np.array([t.r for t in top])
    wanted = np.zeros(1 << BITS, bool)
    wanted[places] = True

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = column_bytes(batch.column(2))
            for lo, hi in parts(off, 1 << 19):
                row, g = present(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], wanted)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                at = np.searchsorted(places, g)
                yield pa.RecordBatch.from_pydict({"label": batch.column(1).slice(lo, hi - lo).cast(pa.float64()), "at": pa.array([at[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int32()))})

    size, values = len(places), r

    @F.udf(VectorUDT())
    def vector(at):  # once for each labelled row
        return SparseVector(size, at, values[at])

    found = shared.durable(rows.select("id", "y", "text").mapInArrow(vectors, "label double, at array<int>"))
    weights, intercept = supervised.fit_logistic(found.select("label", vector("at").alias("features")), n1 + n0, True, 2e-4)
    return Toxic(places, weights * r, intercept)


def score(docs: DataFrame, model: Toxic, text: str = "text") -> DataFrame:
    """The rows of docs with score (double) and predicted (int)."""
    shared.tune(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        wanted = table != 0
        for batch in batches:
            data, off = column_bytes(batch.column(at))
            s = np.full(batch.num_rows, model.intercept)
            for lo, hi in parts(off, 1 << 20):
                row, g = present(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], wanted)
                s[lo:hi] += np.bincount(row, weights=table[g], minlength=hi - lo)
            s = supervised.sigmoid(s)
            yield pa.RecordBatch.from_pydict({c: batch.column(i) for i, c in enumerate(kept)} | {"score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))})

    kinds = dict(docs.dtypes)
    return shared.pick(docs, *kept).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", score double, predicted int")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (shared.crc_mod("doc_id", FOLD) == HELD).alias("held_out"), "score", "predicted")


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLE: dict[str, str] = {}
