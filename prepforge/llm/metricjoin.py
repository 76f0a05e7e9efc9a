"""Jaccard join of shingle sets as a recursive metric-space join, for near-exact copies.

The symmetric difference of two sets is a metric, and sets of a Jaccard similarity of p or more differ in at most (1 - p) / p of the smaller
one. Regions use it twice:

1. Pivots of the first level are shingles. For an order of all shingles, the number of a set's shingles before a pivot changes by no more than
   the symmetric difference; a set's own cell is that of its first shingle, and its window holds the cells of as many following ones as a
   linked set may lack. So linked sets meet in the cell of their first common shingle. (Documents as pivots would not do here: unrelated
   texts share nothing, are all at distance 1 from all pivots, and would lie in all windows.) Any order is exact; one that puts frequent
   shingles last keeps cells small. It comes from what tasks find often, at most FREQUENT shingles, and is all that is broadcast.
2. A region of more than LEAF sets gets PIVOTS of its sets as pivots. Distances are those of count vectors (shingles in VECTOR hash ranges),
   which never exceed the symmetric difference: a set goes to its nearest pivot, and to every pivot that is not further than the nearest
   one by more than twice the set's radius, which is the window that the triangle inequality needs. Regions divide so, recursively.

Small regions are compared exhaustively, by sizes and count vectors, which exclude only what cannot be linked; what is left is compared
on full sets. Regions that their pivots do not separate (near copies of each other) are compared whole on full sets, as
in `neardup`: with a few of their sets first, and then what is still outside the largest component with all. No step loses a link.

Defined cases: as in `neardup`. Null or blank text has no shingles and no links; a text of fewer words than a shingle has one, the whole
sequence; rows without doc_id are linked with nothing; rows that repeat a doc_id all get a row and follow their own set; an empty table gives
no rows; ties do not matter; very long texts are read whole; other columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .neardup import PAIRS_AT_ONCE, compared, set_hashes, set_nodes, shingle_sets, smallest_reachable, verdicts
from .textcore import U64, column_bytes, mix, parts

SHINGLE, PERCENT = 3, 90
LEAF, PIVOTS, VECTOR = 256, 16, 128
#: A region is not separated if one of its parts keeps a larger share of it.
SPLIT = 0.5
#: Shingles that a task counts at once, how often a frequent one occurs in them, and how many go into the order at most.
COUNTED, OFTEN, FREQUENT = 1 << 22, 8, 1 << 20


def _sliced(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """lo, hi, and the sorted distinct shingles of rows lo to hi with the row of each."""
    data, off = column_bytes(column)
    for lo, hi in parts(off, 1 << 20):
        yield lo, hi, *shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)


def frequent(docs: DataFrame, text: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that tasks find often, sorted, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def counted() -> pa.RecordBatch:
            g, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= OFTEN
            return pa.RecordBatch.from_pydict({"g": pa.array(g[often].view(np.int64)), "n": pa.array(times[often])})

        for batch in batches:
            for _, _, g, _ in _sliced(batch.column(0), k):
                held.append(g)
                n += len(g)
                if n >= COUNTED:
                    yield counted()
                    held, n = [], 0
        if held:
            yield counted()

    found = shared.durable(shared.pick(docs, text).mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")))
    # the most frequent ones, by powers of two of their number
    by_power = sorted(((r.p, r.c) for r in found.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("c")).collect()), reverse=True)
    total, least = 0, 64
    for p, c in by_power:
        if total + c > FREQUENT:
            break
        total, least = total + c, p
    rows = found.filter(F.floor(F.log2("n")) >= least).toArrow()
    g = rows.column("g").to_numpy().view(U64)
    order = np.argsort(g)
    return g[order], rows.column("n").to_numpy()[order]


def _signed(docs: DataFrame, key: str, text: str, k: int, percent: int, often: tuple[np.ndarray, np.ndarray], keep: tuple[str, ...]) -> DataFrame:
    """key (as doc), the columns in keep, n_shingles, two hashes of the set (null without shingles), the shingles of its window, and its count vector."""
    held = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = held.value
        for batch in batches:
            for lo, hi, g, rows in _sliced(batch.column(1), k):
                m = hi - lo
                n = np.bincount(rows, minlength=m)
                has = np.flatnonzero(n)
                keys = np.zeros((2, m), np.int64)
                if len(has):
                    keys[:, has] = set_hashes(g, (np.cumsum(n) - n)[has])
                late = np.zeros(len(g), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                    late = np.where(known[at] == g, times[at], 0)
                order = np.lexsort((late, rows))  # within a row shingles are sorted, and stay so among equals
                place = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
                window = n - -(-percent * n // 100) + 1
                window[n == 0] = 0
                first = g[order][place < window[rows]]
                none = n == 0
                cells = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(window)], pa.int32()), pa.array(first.view(np.int64)))
                count = np.bincount(rows * VECTOR + (g >> U64(57)).astype(np.int64), minlength=m * VECTOR).reshape(m, VECTOR)
                vector = pa.array([x.tobytes() for x in np.minimum(count, 255).astype(np.uint8)], pa.binary())
                own = {c: batch.column(i).slice(lo, m) for i, c in ((0, "doc"), *enumerate(keep, 2))}
                yield pa.RecordBatch.from_pydict(own | {"n_shingles": pa.array(n.astype(np.int64)), "k1": pa.array(keys[0], mask=none), "k2": pa.array(keys[1], mask=none), "cells": cells, "vector": vector})

    kept = "".join(f", `{c}` {kind}" for c, kind in docs.dtypes if c in keep)
    return shared.pick(docs, key, text, *keep).mapInArrow(run, f"doc long{kept}, n_shingles long, k1 long, k2 long, cells array<long>, vector binary")


def _vectors(column: pa.Array) -> np.ndarray:
    data, _ = column_bytes(column)
    return data.reshape(-1, VECTOR)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of absolute differences of count vectors (rows of bytes), a few thousand at a time."""
    out = np.empty(len(a), np.int64)
    for lo in range(0, len(a), 4096):
        x, y = a[lo : lo + 4096], b[lo : lo + 4096]
        out[lo : lo + 4096] = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64)
    return out


def _parted(members: DataFrame, percent: int) -> DataFrame:
    """parent, path and node: each set (path, node, n, vector, pivots) of a region goes to its nearest pivot and to those that its window reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pivots = batch.column(4)
            size = pivots.value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(size)), size)
            d = distances(_vectors(batch.column(3))[owner], _vectors(pivots.flatten()))
            nearest = np.minimum.reduceat(d, np.cumsum(size) - size)
            radius = (100 - percent) * batch.column(2).to_numpy() // percent
            inside = np.flatnonzero(d <= (nearest + 2 * radius)[owner])
            place = (np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size))[inside]
            path = batch.column(0).to_numpy().view(U64)[owner[inside]]
            child = mix(path ^ mix(place.astype(U64) + U64(1)))
            of = pa.array(owner[inside])
            yield pa.RecordBatch.from_pydict({"parent": batch.column(0).take(of), "path": pa.array(child.view(np.int64)), "node": batch.column(1).take(of)})

    return members.select("path", "node", "n", "vector", "pivots").mapInArrow(run, "parent long, path long, node long")


def _regions(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """path and node of all small regions, and of those that pivots do not separate (None, if there are none)."""
    rows = sets.select("node", F.explode("cells").alias("path"))
    sizes = shared.durable(rows.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1"))
    rows = shared.durable(rows.join(sizes.select("path"), "path").select("path", "node"))  # the others are alone in their cell
    small, stuck = None, None
    while True:
        large = sizes.filter(F.col("size") > LEAF)
        n_large = large.count()
        own = rows.join(sizes.filter(F.col("size") <= LEAF), "path").select("path", "node")
        small = own if small is None else small.unionByName(own)
        if not n_large:
            return small, stuck
        # written once, as are the inseparable regions' rows: the rows of a large region are not made again for each look at them
        held = shared.durable(shared.semi(rows, large.select("path"), "path", n_large))
        inside = held.join(sets.select("node", "n", "vector"), "node")
        chance = F.xxhash64("node", "path")
        picked = inside.groupBy("path", F.pmod(chance, F.lit(PIVOTS)).alias("p")).agg(F.min_by("vector", F.struct(chance, "node")).alias("v"))
        pivots = shared.durable(picked.groupBy("path").agg(F.array_sort(F.collect_set("v")).alias("pivots")))
        near = F.broadcast(pivots) if n_large * PIVOTS * VECTOR <= shared.BROADCAST_BYTES else pivots
        children = shared.durable(_parted(inside.join(near, "path"), percent))
        counts = shared.durable(children.groupBy("parent", "path").agg(F.count("*").alias("size")).filter("size > 1"))
        most = counts.groupBy("parent").agg(F.max("size").alias("most")).join(large.withColumnRenamed("path", "parent"), "parent")
        kept = shared.durable(most.filter(F.col("most") > SPLIT * F.col("size")).select("parent"))
        n_kept = kept.count()
        if n_kept:
            these = shared.durable(shared.semi(held, kept.withColumnRenamed("parent", "path"), "path", n_kept))
            stuck = these if stuck is None else stuck.unionByName(these)
            children, counts = shared.without(children, kept, "parent", n_kept), shared.without(counts, kept, "parent", n_kept)
        # each part is half of its region at most, or the region is given up: there are fewer rounds than binary digits in the largest size
        rows, sizes = children.select("path", "node"), counts.select("path", "size")


def _cells(groups: DataFrame, percent: int) -> DataFrame:
    """cell, node and n for the sets m (node, n, vector) of each small region that sizes and count vectors allow to be linked; a cell is named by its smallest node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column(0)
            x, size = m.flatten(), m.value_lengths().to_numpy()
            begin = np.cumsum(size) - size
            node, n, vector = x.field(0).to_numpy(), x.field(1).to_numpy(), _vectors(x.field(2))
            ones, twos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s in np.unique(size[size > 1]).tolist():
                a, b = np.triu_indices(s, 1)
                step = max(1, PAIRS_AT_ONCE // len(a))
                of = begin[size == s]
                for lo in range(0, len(of), step):
                    i, j = (of[lo : lo + step, None] + a).ravel(), (of[lo : lo + step, None] + b).ravel()
                    fit = percent * np.maximum(n[i], n[j]) <= 100 * np.minimum(n[i], n[j])
                    i, j = i[fit], j[fit]
                    near = (100 + percent) * distances(vector[i], vector[j]) <= (100 - percent) * (n[i] + n[j])
                    ones.append(i[near])
                    twos.append(j[near])
            i, j = np.concatenate(ones), np.concatenate(twos)
            label = smallest_reachable(len(node), i, j)
            inside = np.unique(np.r_[i, j])
            low = np.full(len(node), np.iinfo(np.int64).max)
            np.minimum.at(low, label[inside], node[inside])
            yield pa.RecordBatch.from_pydict({"cell": pa.array(low[label[inside]]), "node": pa.array(node[inside]), "n": pa.array(n[inside])})

    return groups.select("m").mapInArrow(run, "cell long, node long, n long")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key (an integer column), the columns in keep (of names that no helper has), n_shingles and component_id (the smallest key reachable over links)."""
    shared.tune(docs.sparkSession)
    docs = docs.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").alias(text), *[F.col(f"`{c}`") for c in keep])
    table = shared.durable(_signed(docs, key, text, shingle, percent, frequent(docs, text, shingle), keep))
    sets = shared.durable(set_nodes(table, "n_shingles", "cells", "vector").withColumnRenamed("n_shingles", "n"))
    small, stuck = _regions(sets, percent)
    member = F.collect_list(F.struct("node", "n", "vector")).alias("m")
    groups = small.join(sets.select("node", "n", "vector"), "node").groupBy("path").agg(member)
    labels = compared(_cells(groups, percent), stuck, sets, docs, percent, shingle, key, text)
    return verdicts(table, sets, labels, key, keep).drop("kept")


def op11_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_jaccard_join": op11_jaccard_join}
ORACLE = {
    "op11_jaccard_join": r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (
  select distinct doc_id, array_to_string(list_slice(ws, i, i + least(len(ws), 3) - 1), ' ') as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 90 * (x.n + y.n - common)),
e as (select a as u, b as v from links union all select b, a from links),
reach(u, v) as (select doc_id, doc_id from d union select reach.u, e.v from reach join e on reach.v = e.u),
c as (select u as doc_id, min(v) as component_id from reach group by u)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id from d left join n using (doc_id) join c using (doc_id)""",
}
