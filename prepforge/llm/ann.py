"""Approximate nearest neighbours by shifted space-filling curves.

Each of several orderings projects the unit vectors on a few random directions, scales the coordinates to a grid, shifts the grid, and
sorts all vectors along a Hilbert curve. Spark's range partitioning does the sorting; a vector's place in an ordering follows from counts
of the partitions. A query looks into the orderings whose directions hold most of its length (PROBES of ORDERINGS), where its neighbours
stand closest to it. There it goes to the blocks of places that its window touches, and is compared with the vectors of the window in
half precision; the best of all windows merge, and the merged list is ranked by the exact cosine of the original vectors.

The window is the one recall parameter: a share of all places on either side of the query (SHARE). A query is compared with
2 * SHARE * PROBES * N vectors, 0.64 N by default (below 3,200 vectors with more, as a window has LEAST_REACH places on either side): vectors without structure (64 directions of equal variance, the nearest at a cosine of
0.5) need that for a recall above 0.9, whatever the number of vectors; with clusters a hundredth does. The work of all queries is the
product of their number and that share of N. The exact search is orderings=1, probes=1, share=1: every window is the whole table, still
in blocks of bounded size.

Each block is one task's work of bounded size: queries of a block are split by salts, and only the k + MARGIN best of each query and block
leave it.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without id or of
another length than most; rows that repeat an id are one vector, whose best score counts, and a query's own id is never among its results;
ties go to the smaller id; an empty table gives no rows; other columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

ORDERINGS, PROBES, DIMS, BITS = 48, 16, 6, 5
#: Reach of a window to either side: a share of all places, and at least so many.
SHARE, LEAST_REACH = 0.02, 64
#: Least and most places of a block, and queries that a block is compared with in one group.
LEAST_BLOCK, BLOCK, QUERIES_A_TASK = 64, 8192, 4096
#: Kept of each block beyond k, so that the exact measure decides between scores that differ by rounding.
MARGIN = 16
SEED = 20


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of each row of cells (n x dims, values below 2 ** bits) along the Hilbert curve.

    The curve's Gray-code form: from the highest bit down, each axis with a set bit inverts the lower bits of the first axis, and each
    axis without swaps its lower bits with the first axis; a Gray decode over the axes then gives the digits, bit by bit.
    """
    x = cells.astype(np.uint32).copy()
    n, dims = x.shape
    for b in range(bits - 1, 0, -1):
        q, low = np.uint32(1 << b), np.uint32((1 << b) - 1)
        for i in range(dims):
            on = (x[:, i] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low).astype(np.uint32)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, np.uint32)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[:, dims - 1] & np.uint32(1 << b), np.uint32((1 << b) - 1), np.uint32(0))
    x ^= flip[:, None]
    key = np.zeros(n, np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[:, i] >> np.uint32(b)) & np.uint32(1)).astype(np.uint64)
    return key


class Orderings:
    """Projections and shifts, from a seed."""

    def __init__(self, width: int, orderings: int, dims: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        dims = min(dims, width)
        # each projection is orthonormal, so that the cells of an ordering keep distances as far as so few dimensions can
        self.axes = [np.linalg.qr(rng.standard_normal((width, dims)))[0] for _ in range(orderings)]
        self.shifts = rng.random((orderings, dims))
        self.bits, self.scale = bits, 2.5 / np.sqrt(width)

    def lengths(self, unit: np.ndarray) -> np.ndarray:
        """How long each vector is along the directions of each ordering."""
        return np.stack([np.square(unit @ a).sum(axis=1) for a in self.axes], axis=1)

    def keys(self, unit: np.ndarray, t: int) -> np.ndarray:
        top = 1 << self.bits
        p = np.clip(unit @ self.axes[t] / self.scale, -1, 1)
        cells = np.minimum((p + 1) / 2 * (top - 1) + self.shifts[t], top - 1)
        return hilbert_keys(cells, self.bits)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of rows of q and v in double precision."""
    return (q * v).sum(axis=-1) / (np.sqrt((q * q).sum(axis=-1)) * np.sqrt((v * v).sum(axis=-1)))


def _best(take: int, width: int):
    """The take best vectors of the window of each query within a block, by half-precision cosine."""

    def rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float16).reshape(-1, width)
        return table.column("id").to_numpy(), table.column("pos").to_numpy(), v.astype(np.float32)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "near": []}
        if left.num_rows and right.num_rows:
            qi, qp, q = rows(left)
            vi, vp, v = rows(right)
            reach = left.column("reach").to_numpy()
            some = min(take, len(vi))
            for lo in range(0, len(qi), 256):
                near = q[lo : lo + 256] @ v.T
                out_of = (np.abs(vp[None, :] - qp[lo : lo + 256, None]) > reach[lo : lo + 256, None]) | (vi[None, :] == qi[lo : lo + 256, None])
                near[out_of] = -np.inf
                top = np.argpartition(-near, some - 1, axis=1)[:, :some]
                a, b = np.nonzero(np.isfinite(np.take_along_axis(near, top, axis=1)))
                b = top[a, b]
                out["query_id"].append(qi[lo + a])
                out["vec_id"].append(vi[b])
                out["near"].append(near[a, b])
        kinds = {"query_id": pa.int64(), "vec_id": pa.int64(), "near": pa.float32()}
        return pa.table({c: pa.array(np.concatenate(x) if x else [], kinds[c]) for c, x in out.items()})

    return run


def _exact(found: DataFrame, fine: DataFrame) -> DataFrame:
    """query_id, vec_id and score of the pairs (query_id, vec_id), by the original vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                q, v = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("q", "v"))
                yield pa.RecordBatch.from_pydict({"query_id": batch.column("query_id"), "vec_id": batch.column("vec_id"), "score": pa.array(cosine(q, v))})

    asked = fine.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    held = fine.select(F.col("id").alias("vec_id"), "v")
    scored = found.join(asked, "query_id").join(held, "vec_id").select("query_id", "vec_id", "q", "v").mapInArrow(run, "query_id long, vec_id long, score double")
    return scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def nearest(vectors: DataFrame, queries: str, k: int = 5, key: str = "vec_id", vector: str = "embedding", orderings: int = ORDERINGS, probes: int = PROBES, dims: int = DIMS, bits: int = BITS, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each row for which the SQL condition queries (over id) holds."""
    spark = vectors.sparkSession
    shared.tune(spark)
    own = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).filter("id is not null and size(v) > 0")
    usual = own.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = usual.w
    fine = own.filter(F.size("v") == width).filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).filter(F.exists("v", lambda x: x != 0))
    curves = Orderings(width, orderings, dims, bits, SEED)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
            half = unit.astype(np.float16)
            vec = pa.array([r.tobytes() for r in half], pa.binary())
            # a query asks the orderings along which it is longest
            chosen = np.zeros((len(unit), orderings), bool)
            np.put_along_axis(chosen, np.argsort(-curves.lengths(unit), axis=1, kind="stable")[:, :probes], True, axis=1)
            chosen &= batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)[:, None]
            for t in range(orderings):
                place = curves.keys(unit, t).view(np.int64)  # below 2 ** 63, as dims * bits is
                yield pa.RecordBatch.from_pydict({"t": pa.array(np.full(len(unit), t, np.int32)), "key": pa.array(place), "id": batch.column(0), "asks": pa.array(chosen[:, t]), "vec": vec})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asking = fine.select("id", "v", F.expr(queries).cast("boolean").alias("asks"))
    along = asking.mapInArrow(keyed, "t int, key long, id long, asks boolean, vec binary").repartitionByRange(parts, "t", "key", "id").sortWithinPartitions("t", "key", "id")
    along = shared.durable(along.withColumn("part", F.spark_partition_id()))
    # one count for each partition and ordering: bounded by partitions plus orderings
    counts = sorted((r.t, r.part, r.n, r.q) for r in along.groupBy("t", "part").agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).collect())
    before, total, asked_of = {}, {}, {}
    for t, part, n, q in counts:
        before[(t, part)] = total.get(t, 0)
        total[t], asked_of[t] = total.get(t, 0) + n, asked_of.get(t, 0) + q
    n, n_asked = max(total.values(), default=0), max(asked_of.values(), default=0)
    reach = max(k, LEAST_REACH, int(np.ceil(share * n)))
    block = min(block, max(LEAST_BLOCK, reach // 2))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            t, part = batch.column(0).to_numpy(), batch.column(5).to_numpy()
            pos = np.empty(len(t), np.int64)
            for x in np.unique(t).tolist():
                at = np.flatnonzero(t == x)
                start = seen.get(x, before[(x, int(part[at[0]]))])
                pos[at] = start + np.arange(len(at))
                seen[x] = start + len(at)
            yield pa.RecordBatch.from_pydict({"t": batch.column(0), "pos": pa.array(pos), "id": batch.column(2), "asks": batch.column(3), "vec": batch.column(4)})

    # queries whose windows touch one block, at the mean density of the ordering that is asked most
    spread = max(1, -(-n_asked * (2 * reach + block) // max(n, 1) // QUERIES_A_TASK))
    known = along.mapInArrow(placed, "t int, pos long, id long, asks boolean, vec binary")
    salt = F.lit(0) if spread == 1 else F.pmod(F.xxhash64("id"), F.lit(spread)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    asked = known.filter("asks").withColumn("reach", F.lit(reach).cast("long")).withColumn("block", F.explode(F.sequence(F.floor(F.greatest(F.col("pos") - reach, F.lit(0)) / block), F.floor(F.least(F.col("pos") + reach, F.lit(n - 1)) / block)))).withColumn("salt", salt)
    held = known.drop("asks").withColumn("block", F.floor(F.col("pos") / block)).withColumn("salt", salts)
    near = asked.groupBy("t", "block", "salt").cogroup(held.groupBy("t", "block", "salt")).applyInArrow(_best(k + MARGIN, width), "query_id long, vec_id long, near float")
    merged = near.groupBy("query_id", "vec_id").agg(F.max("near").alias("near"))
    first = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
    scored = _exact(merged.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + MARGIN).select("query_id", "vec_id"), fine)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 50 = 0")


QUERIES = {"op6_nearest": op6_nearest}
#: SQL can express the exact search only; recall against it is tested.
ORACLE: dict[str, str] = {}
