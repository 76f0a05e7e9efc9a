"""Near-duplicates by a chosen-path similarity join over minwise tokens.

Each document's set of word shingles gets a vector of minwise values; equal sets are one class, which a single representative stands for.
TREES independent trees branch the classes. The root of a tree branches by one minwise token; a node of more than LEAF classes branches
again, by two other tokens, so that a class goes on to two children, and so on until nodes are small. A pair of similarity 0.75 shares a
child of a node that it shares with a probability of 0.94, and goes on together to any depth with one of 0.89 (two children each survive
with 0.75, as a branching process). It shares no small node of any of ten trees with a probability below 3e-5.

Small nodes are compared exhaustively by sketches (COORDINATES minwise values of 16 bits); classes that candidates connect form a cell,
cells of all trees with one smallest member are united, and in each cell all pairs are compared exactly, on full sets. A branch that keeps
more than half of its node's classes together does not separate them: they share most of their tokens. Such a node, united with those of
other trees that have the same core, is compared whole on full sets: first all its classes with a few of them, which connects copies in
linear work, and then the classes that are still outside the largest component with all classes of the node, block by block. No candidate is left out for its number of partners; the work for a node
that holds many texts just below the threshold grows with its square.

Comparisons of full sets yield, for each component of a group, links to its smallest class only. Components come from hooking each class on
its smallest neighbour, round after round, and pointer doubling. Groups hold WEIGHT shingles on average, or one longer text.

Recall against brute force is measured in the tests and stated in the README. A pair at the threshold is lost by its sketches with a
probability of 3e-4 (SLACK), by the trees with one of 3e-5; pairs above it far less. Branches deeper than seven levels use tokens again.

Defined cases: null or blank text has no shingles and no links; a text of fewer words than a shingle has one, the whole sequence; rows
without doc_id are linked with nothing (component_id null, kept true); rows that repeat a doc_id all get a row, and each row follows its own
set: component_id is the smallest doc_id of any row whose set is reachable from the row's set; an empty table gives no rows; ties do not matter,
as components have no order; very long texts are groups of their own; other columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .fragments import low_bytes
from .textcore import SPACE, U64, Words, column_bytes, mix, parts, windows

SHINGLE, PERCENT = 5, 75
COORDINATES, TREES, LEAF = 96, 10, 256
#: Children that a class goes on to when its node branches again.
CHOICES = 2
#: A node does not separate if a child keeps a larger share of it.
SPLIT = 0.5
#: Classes of an inseparable node that all others are compared with at first.
PIVOTS = 3
#: Shingles of a group of exact comparisons, and what a text counts besides its own.
WEIGHT, TEXT_WEIGHT = 1 << 20, 1 << 10
#: Nodes of sets whose smallest doc_id stands for another set already begin here; doc_ids are below.
APART = 1 << 62
#: A pair goes to the exact check if so many standard deviations below the threshold, or more, of its coordinates agree.
SLACK = 3.5
#: Tokens of more texts of a group than this are counted by a matrix product, others pair by pair.
COMMON = 12
COLUMNS_AT_ONCE, PAIRS_AT_ONCE = 2048, 1 << 18


def _agreement(percent: int) -> int:
    p = percent / 100
    return int(COORDINATES * p - SLACK * (COORDINATES * p * (1 - p)) ** 0.5)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, sorted within each row, and the row of each."""
    w = Words(data, off, SPACE, True)
    h = w.hashes()
    g, at = windows(h, w.rows, k)
    rows = w.rows[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        whole = np.array([mix(np.array([np.bitwise_xor.reduce(mix(h[a : a + n] + np.arange(1, n + 1, dtype=U64)))], U64))[0] + U64(n) for a, n in zip(w.row_first[short], w.counts[short], strict=True)], U64)
        g, rows = np.r_[g, whole], np.r_[rows, short]
    order = np.lexsort((g, rows))
    g, rows = g[order], rows[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (rows[1:] != rows[:-1])
    return g[first], rows[first]


def set_hashes(g: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Two hashes of each set of g, as rows."""
    return np.stack([np.add.reduceat(mix(g ^ U64(0xA5A5 + i)), begin).view(np.int64) for i in (0, 1)])


def signatures(docs: DataFrame, key: str, text: str, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """key (as doc), the columns in keep, n_shingles, two hashes of the set (null without shingles), the minwise values of the roots, and a 16-bit sketch of all."""
    factors = mix(np.arange(1, COORDINATES + 1, dtype=U64) * U64(0xD6E8FEB86659FD93)) | U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = column_bytes(batch.column(1))
            for lo, hi in parts(off, 1 << 20):
                g, rows = shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
                n = np.bincount(rows, minlength=hi - lo)
                has = np.flatnonzero(n)
                begin = (np.cumsum(n) - n)[has]
                sig = np.empty((len(has), COORDINATES), np.uint32)
                keys = np.zeros((2, hi - lo), np.int64)
                if len(has):
                    for i, a in enumerate(factors):
                        sig[:, i] = (np.minimum.reduceat(g * a, begin) >> U64(32)).astype(np.uint32)
                    keys[:, has] = set_hashes(g, begin)
                none = n == 0
                roots = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(none, 0, TREES))], pa.int32()), pa.array(sig[:, :TREES].ravel().view(np.int32)))
                sketch = np.full(hi - lo, None, object)
                sketch[has] = [x.tobytes() for x in sig.astype(np.uint16)]
                own = {c: batch.column(i).slice(lo, hi - lo) for i, c in ((0, "doc"), *enumerate(keep, 2))}
                yield pa.RecordBatch.from_pydict(own | {"n_shingles": pa.array(n.astype(np.int64)), "k1": pa.array(keys[0], mask=none), "k2": pa.array(keys[1], mask=none), "roots": roots, "sketch": pa.array(sketch, pa.binary())})

    kept = "".join(f", `{c}` {kind}" for c, kind in docs.dtypes if c in keep)
    return shared.pick(docs, key, text, *keep).mapInArrow(run, f"doc long{kept}, n_shingles long, k1 long, k2 long, roots array<int>, sketch binary")


def _sketch_matrix(column: pa.Array) -> np.ndarray:
    data, _ = column_bytes(column)
    return data.view(np.uint16).reshape(-1, COORDINATES)


def smallest_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of n places that each place reaches over the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label


def _branched(rows: DataFrame, level: int) -> DataFrame:
    """parent, path and node: each class of a node (path, node, sketch) goes on to CHOICES children, by tokens that the node chooses."""
    span = COORDINATES - TREES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column(0).to_numpy().view(U64)
            sketch = _sketch_matrix(batch.column(2))
            for c in range(CHOICES):
                # every level has tokens of its own, from which each node chooses by its hash
                token = TREES + (level * 12 + c * 6 + (mix(path + U64(c)) % U64(6)).astype(np.int64)) % span
                value = sketch[np.arange(len(path)), token].astype(U64)
                child = mix(path ^ mix(value + (token.astype(U64) << U64(32)) + U64(1)))
                yield pa.RecordBatch.from_pydict({"parent": batch.column(0), "path": pa.array(child.view(np.int64)), "node": batch.column(1)})

    return rows.select("path", "node", "sketch").mapInArrow(run, "parent long, path long, node long")


def _cells(groups: DataFrame, least: int) -> DataFrame:
    """cell, node and n for the classes m (node, n, sketch) of each small node that candidates connect; a cell is named by its smallest class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column(0)
            x = m.flatten()
            size = m.value_lengths().to_numpy()
            begin = np.cumsum(size) - size
            node, n, sketch = x.field(0).to_numpy(), x.field(1).to_numpy(), _sketch_matrix(x.field(2))
            ones, twos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s in np.unique(size[size > 1]).tolist():
                a, b = np.triu_indices(s, 1)
                step = max(1, PAIRS_AT_ONCE // len(a))
                of = begin[size == s]
                for lo in range(0, len(of), step):
                    i, j = (of[lo : lo + step, None] + a).ravel(), (of[lo : lo + step, None] + b).ravel()
                    agree = np.zeros(len(i), np.uint8)
                    for at in range(0, len(i), 4096):
                        agree[at : at + 4096] = (sketch[i[at : at + 4096]] == sketch[j[at : at + 4096]]).sum(axis=1)
                    near = agree >= least
                    ones.append(i[near])
                    twos.append(j[near])
            i, j = np.concatenate(ones), np.concatenate(twos)
            label = smallest_reachable(len(node), i, j)
            inside = np.unique(np.r_[i, j])
            low = np.full(len(node), np.iinfo(np.int64).max)
            np.minimum.at(low, label[inside], node[inside])
            yield pa.RecordBatch.from_pydict({"cell": pa.array(low[label[inside]]), "node": pa.array(node[inside]), "n": pa.array(n[inside])})

    return groups.select("m").mapInArrow(run, "cell long, node long, n long")


def full_sets(docs: DataFrame, wanted: DataFrame, n_wanted: int, key: str, text: str, k: int) -> DataFrame:
    """Sorted 48-bit shingle hashes (binary) of the sets in wanted (node, low, k1), each read from a document low; partitioned by node: no comparison shuffles them again before they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = column_bytes(batch.column(2))
            node, asked = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in parts(off, 1 << 20):
                g, rows = shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
                edges = np.searchsorted(rows, np.arange(hi - lo + 1))
                own = [i for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a and set_hashes(g[a:b], np.zeros(1, np.int64))[0][0] == asked[lo + i]]
                grams = pa.array([low_bytes(g[edges[i] : edges[i + 1]] >> U64(16), 6) for i in own], pa.binary())
                yield pa.RecordBatch.from_pydict({"node": node.take(pa.array([lo + i for i in own], pa.int64())), "grams": grams})

    right = F.broadcast(wanted) if n_wanted * 24 <= shared.BROADCAST_BYTES else wanted
    texts = shared.pick(docs, key, text).withColumnRenamed(key, "low").join(right, "low").select("node", "k1", text)
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shared.durable(texts.mapInArrow(run, "node long, grams binary").repartition(n_parts, "node").dropDuplicates(["node"]))


def common_tokens(tokens: np.ndarray, rows: np.ndarray, unit: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All that token_pairs yields, at once."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)), *token_pairs(tokens, rows, unit, right)]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def token_pairs(tokens: np.ndarray, rows: np.ndarray, unit: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of one unit that share tokens, and how many, PAIRS_AT_ONCE places at a time; rows are sorted by unit. Where a unit has rows on the right, only pairs of a left and a right row count.

    tokens and rows: the tokens of all rows. Tokens of few rows are counted pair by pair, others by a product of 0-1 matrices.
    """
    n_rows = len(unit)
    first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if n_rows else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, n_rows])
    of_unit = np.repeat(np.arange(len(first)), size)
    local = np.arange(n_rows) - first[of_unit]
    two_sided = np.maximum.reduceat(right.astype(np.int64), first) > 0 if n_rows else np.zeros(0, bool)
    base = np.cumsum(size * size) - size * size
    shared_by = np.zeros(int((size * size).sum()), np.int32)
    keyed = mix(tokens + mix(of_unit[rows].astype(U64) + U64(1)))
    order = np.argsort(keyed, kind="stable")
    keyed, rows = keyed[order], rows[order]
    start = np.flatnonzero(np.r_[True, keyed[1:] != keyed[:-1]]) if len(keyed) else np.zeros(0, np.int64)
    run_of = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(keyed)]))
    held = np.diff(np.r_[start, len(keyed)])
    few = held[run_of] <= COMMON
    for d in range(1, COMMON):
        if d >= len(keyed):
            break
        at = np.flatnonzero((run_of[:-d] == run_of[d:]) & few[:-d])
        if not len(at):
            break
        a, b = rows[at], rows[at + d]
        u = of_unit[a]
        np.add.at(shared_by, base[u] + local[a] * size[u] + local[b], 1)
        np.add.at(shared_by, base[u] + local[b] * size[u] + local[a], 1)
    common = np.flatnonzero(~few)
    u = of_unit[rows[common]]
    for x in np.unique(u).tolist():
        own = common[u == x]
        column = np.unique(run_of[own], return_inverse=True)[1]
        total = np.zeros((size[x], size[x]), np.float32)
        by_column = np.argsort(column, kind="stable")
        column, row = column[by_column], local[rows[own]][by_column]
        for lo in range(0, int(column[-1]) + 1, COLUMNS_AT_ONCE):
            p, q = np.searchsorted(column, (lo, lo + COLUMNS_AT_ONCE))
            holds = np.zeros((size[x], min(COLUMNS_AT_ONCE, int(column[-1]) + 1 - lo)), np.float32)
            holds[row[p:q], column[p:q] - lo] = 1
            total += holds @ holds.T
        shared_by[base[x] : base[x] + size[x] ** 2] += total.astype(np.int32).ravel()
    for lo in range(0, len(shared_by), PAIRS_AT_ONCE):
        at = lo + np.flatnonzero(shared_by[lo : lo + PAIRS_AT_ONCE])
        u = np.searchsorted(base, at, "right") - 1
        i, j = first[u] + (at - base[u]) // size[u], first[u] + (at - base[u]) % size[u]
        ok = np.where(two_sided[u], ~right[i] & right[j], i < j)
        yield i[ok], j[ok], shared_by[at[ok]]


def linked(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b), b < a, of the exact comparison of rows (g, unit, side, node): all pairs of a unit, or those of its sides 0 and 1. Units of one g are one group of work. A component within a unit gives one link for each of its other classes."""

    def run(table: pa.Table) -> pa.Table:
        unit, node = table.column("unit").to_numpy(), table.column("node").to_numpy()
        order = np.argsort(unit, kind="stable")
        unit, node, right = unit[order], node[order], table.column("side").to_numpy()[order] == 1
        raw, off = column_bytes(table.column("grams").combine_chunks().take(pa.array(order)) if table.num_rows else pa.array([], pa.binary()))
        n = np.diff(off) // 6
        wide = np.zeros((len(raw) // 6, 8), np.uint8)
        wide[:, :6] = raw.reshape(-1, 6)
        ones, twos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j, both in token_pairs(wide.view("<u8").ravel(), np.repeat(np.arange(len(n)), n), unit, right):
            near = (100 * both.astype(np.int64) >= percent * (n[i] + n[j] - both)) & (node[i] != node[j])
            ones.append(i[near])
            twos.append(j[near])
        i, j = np.concatenate(ones), np.concatenate(twos)
        label = smallest_reachable(len(node), i, j)
        low = np.full(len(node), np.iinfo(np.int64).max)
        inside = np.unique(np.r_[i, j])
        np.minimum.at(low, label[inside], node[inside])
        a, b = node[inside], low[label[inside]]
        return pa.table({"a": pa.array(a[a != b]), "b": pa.array(b[a != b])})

    return rows.select("g", "unit", "side", "node").join(sets, "node").groupBy("g").applyInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable, itself included) of every node in links (a, b), b < a.

    Each node hangs on its smallest neighbour, and its other neighbours are handed on to that one, until every node has one neighbour
    at most; pointers are doubled as long as a label has one of its own.
    """
    edges = links.select("a", "b").filter("a > b").distinct()
    least = F.min("b").over(Window.partitionBy("a"))
    edges = shared.durable(edges.withColumn("m", least))
    while True:
        n, several = edges.agg(F.count("*"), F.coalesce(F.bool_or(F.col("b") != F.col("m")), F.lit(False))).first()
        edges = shared.by_rows(edges, n)
        if not several:
            break
        edges = edges.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        # there are never more edges than before
        edges = shared.by_rows(edges.distinct(), n).withColumn("m", least)
        edges = shared.durable(shared.by_rows(edges, n))
    p = edges.select(F.col("a").alias("node"), F.col("m").alias("label"))
    while True:
        up = p.select(F.col("node").alias("label"), F.col("label").alias("above"))
        moved = p.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"), F.col("above").isNotNull().alias("moved"))
        p = shared.durable(shared.by_rows(moved, n))
        if p.filter("moved").isEmpty():
            break
        p = p.select("node", "label")
    p = p.select("node", "label")
    return p.unionByName(shared.by_rows(p.select(F.col("label").alias("node"), "label").distinct(), n))


def _weight(n: str) -> Column:
    return F.col(n) + TEXT_WEIGHT


def _n_parts(weight: Column) -> Column:
    return F.ceil(weight / WEIGHT).cast("int")


def _part(n_parts: Column) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(7)), n_parts).cast("int")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key (an integer column), the columns in keep (of names that no helper has), n_shingles, component_id (the smallest key reachable over links) and kept (whether it is the row's own key)."""
    shared.tune(docs.sparkSession)
    docs = docs.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{text}`").alias(text), *[F.col(f"`{c}`") for c in keep])
    table = shared.durable(signatures(docs, key, text, shingle, keep))
    nodes = set_nodes(table, "n_shingles", "roots", "sketch").withColumnRenamed("n_shingles", "n")
    sketches = shared.durable(shared.by_rows(nodes, table.count()))

    small, stuck = _nodes(sketches)
    member = F.collect_list(F.struct("node", "n", "sketch")).alias("m")
    groups = small.join(sketches.select("node", "n", "sketch"), "node").groupBy("path").agg(member)
    links = compared(_cells(groups, _agreement(percent)), stuck, sketches, docs, percent, shingle, key, text)
    return verdicts(table, sketches, links, key, keep)


def set_nodes(table: DataFrame, *columns: str) -> DataFrame:
    """node, low (the smallest doc), k1, k2 and columns of each distinct set. A node is the set's smallest doc, or a number from APART on where that doc stands for another set."""
    known = table.filter("k1 is not null and doc is not null")
    classes = known.groupBy("k1", "k2").agg(F.min("doc").alias("low"), F.min_by(F.struct(*columns), "doc").alias("x")).select("k1", "k2", "low", "x.*")
    first = classes.groupBy("low").agg(F.min(F.struct("k1", "k2")).alias("f")).select("low", "f.k1", "f.k2", F.lit(True).alias("first"))
    other = F.xxhash64("k1", "k2").bitwiseAND(F.lit(APART - 1)).bitwiseOR(F.lit(APART))
    return classes.join(first, ["low", "k1", "k2"], "left").withColumn("node", F.when(F.col("first"), F.col("low")).otherwise(other)).drop("first")


def compared(cells: DataFrame, stuck: DataFrame | None, sketches: DataFrame, docs: DataFrame, percent: int, shingle: int, key: str, text: str) -> DataFrame | None:
    """node and label of the components that exact comparison finds in cells (cell, node, n) and in inseparable nodes (path, node); None, if there is nothing to compare."""
    cells = cells.repartition("cell").dropDuplicates(["cell", "node"])
    cells = cells.withColumn("n_parts", _n_parts(F.sum(_weight("n")).over(Window.partitionBy("cell"))))
    cells = shared.durable(shared.by_rows(cells, TREES * sketches.count()))
    weight, n_active = cells.agg(F.coalesce(F.sum(_weight("n")), F.lit(0)), F.count("*")).first()
    active = shared.by_rows(cells.select("node").distinct(), n_active)
    whole = _whole_nodes(stuck, sketches) if stuck is not None else None
    if whole is not None:
        n_active += whole.count()
        active = shared.by_rows(active.union(whole.select("node")).distinct(), n_active)
    if not n_active:
        return None
    sets = full_sets(docs, sketches.select("node", "low", "k1").join(active, "node"), n_active, key, text, shingle)
    links = shared.durable(shared.by_rows(linked(_in_blocks(cells, max(1, weight // WEIGHT)), sets, percent), n_active))
    return components(links) if whole is None else _joined(whole, sets, links, percent)


def verdicts(table: DataFrame, nodes: DataFrame, labels: DataFrame | None, key: str, keep: tuple[str, ...]) -> DataFrame:
    """Every row of table with the smallest doc of its set's component."""
    result = table.select("doc", *keep, "n_shingles", "k1", "k2").join(nodes.select("k1", "k2", "node", "low"), ["k1", "k2"], "left")
    result = shared.by_rows(result, table.count())
    if labels is None:
        return _verdict(result.withColumn("label", F.lit(None).cast("long")), key, keep)
    apart = shared.durable(nodes.filter(F.col("node") >= APART).select("node", "low"))
    if not apart.isEmpty():
        # a label is the smallest node, which isn't the smallest doc where sets of one doc are apart
        lows = labels.join(apart, "node").groupBy("label").agg(F.min("low").alias("lower"))
        labels = labels.join(lows, "label", "left").select("node", F.least(F.when(F.col("label") < APART, F.col("label")), "lower").alias("label"))
    return _verdict(result.join(labels, "node", "left"), key, keep)


def _nodes(sketches: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """path and node of all small nodes of the trees, and of the inseparable ones (None, if there are none)."""
    # exploded once, as every step of the first level reads these rows
    rows = shared.durable(sketches.select("node", F.posexplode("roots").alias("tree", "value")).select(F.xxhash64("tree", "value").alias("path"), "node"))
    n_rows = rows.count()
    sizes = shared.durable(shared.by_rows(rows.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1"), n_rows))
    small, stuck, level = None, None, 0
    while True:
        large = sizes.filter(F.col("size") > LEAF)
        n_large, n_inside = large.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        own = shared.without(rows, large.select("path"), "path", n_large) if n_large else rows
        own = shared.by_rows(own.join(sizes.filter(F.col("size") <= LEAF), "path").select("path", "node"), n_rows)
        small = own if small is None else small.unionByName(own)
        if not n_large:
            return small, stuck
        # each level halves every node at least, or gives it up as inseparable: there are fewer levels than binary digits in the number of rows
        # written once, as are the inseparable nodes' rows: the rows of a large node are not made again for each look at them
        inside = shared.durable(shared.by_rows(shared.semi(rows, large.select("path"), "path", n_large), n_inside))
        n_rows = CHOICES * n_inside
        children = shared.durable(shared.by_rows(_branched(inside.join(sketches.select("node", "sketch"), "node"), level), n_rows))
        counts = shared.durable(shared.by_rows(children.groupBy("parent", "path").agg(F.count("*").alias("size")).filter("size > 1"), n_rows))
        most = counts.groupBy("parent").agg(F.max("size").alias("most")).join(large.withColumnRenamed("path", "parent"), "parent")
        kept = shared.durable(shared.by_rows(most.filter(F.col("most") > SPLIT * F.col("size")).select("parent"), n_large))
        n_kept = kept.count()
        if n_kept:
            these = shared.durable(shared.by_rows(shared.semi(inside, kept.withColumnRenamed("parent", "path"), "path", n_kept), n_inside))
            stuck = these if stuck is None else stuck.unionByName(these)
            children, counts = shared.without(children, kept, "parent", n_kept), shared.without(counts, kept, "parent", n_kept)
        rows, sizes, level = children.select("path", "node"), counts.select("path", "size"), level + 1


def _in_blocks(cells: DataFrame, bins: int) -> DataFrame:
    """g, unit, side and node: small cells share groups, larger ones are cut into parts that meet in pairs."""
    one = cells.filter("n_parts <= 1").select(F.pmod(F.xxhash64("cell"), F.lit(bins)).alias("g"), F.col("cell").alias("unit"), F.lit(0).alias("side"), "node")
    cut = cells.filter("n_parts > 1").withColumn("part", _part(F.col("n_parts"))).withColumn("other", F.explode(F.expr("sequence(0, n_parts - 1)")))
    unit = F.xxhash64("cell", F.least("part", "other"), F.greatest("part", "other"))
    met = cut.select(unit.alias("g"), unit.alias("unit"), F.when(F.col("part") > F.col("other"), 1).otherwise(0).alias("side"), "node")
    return one.unionByName(met)


def _whole_nodes(stuck: DataFrame, sketches: DataFrame) -> DataFrame:
    """star, node, n, n_parts and pivots of the inseparable nodes.

    Pivots are classes that are in most of the trees' inseparable nodes, as those are nearest to the core of a group. Nodes of several
    trees with the same pivots are one star, so that a group is compared once and not once for each tree.
    """
    n = stuck.count()
    often = shared.by_rows(stuck.groupBy("node").agg(F.count("*").alias("often")), n)
    rows = shared.by_rows(stuck.join(often, "node"), n)
    pivots = F.array_sort(F.array_distinct(F.array(*[F.max_by("node", F.struct("often", F.xxhash64("node", F.lit(i)))) for i in range(PIVOTS)])))
    chosen = shared.by_rows(rows.groupBy("path").agg(pivots.alias("pivots")), n)
    members = rows.join(chosen, "path").select(F.xxhash64("pivots").alias("star"), "node", "pivots")
    members = shared.by_rows(shared.by_rows(members, n).dropDuplicates(["star", "node"]), n)
    members = shared.by_rows(members.join(sketches.select("node", "n"), "node"), n)
    about = members.groupBy("star").agg(_n_parts(F.sum(_weight("n"))).alias("n_parts"))
    return shared.durable(shared.by_rows(members.join(about, "star"), n))


def _joined(whole: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Components after the comparison of inseparable nodes: with pivots, and then of what is outside the largest component with all."""
    dealt = whole.withColumn("part", _part(F.col("n_parts")))
    unit = F.xxhash64("star", "part").alias("unit")
    members = dealt.select(unit, F.lit(1).alias("side"), "node")
    pivots = dealt.select("star", "part", "pivots").distinct().select(unit, F.lit(0).alias("side"), F.explode("pivots").alias("node"))
    near = linked(members.unionByName(pivots).withColumn("g", F.col("unit")), sets, percent)
    labels = shared.durable(components(links.unionByName(near)))
    n = whole.count()
    labelled = whole.select("star", "node", "n", "n_parts").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = shared.by_rows(labelled, n)
    main = labelled.groupBy("star", "label").count().groupBy("star").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    rest = shared.durable(shared.by_rows(labelled.join(main, "star").filter("label != main").select("star", "node", "n", "n_parts"), n))
    if rest.isEmpty():
        return labels
    cut = rest.groupBy("star").agg(_n_parts(F.sum(_weight("n"))).alias("rest_parts"))
    left = rest.join(cut, "star").select("star", "node", _part(F.col("rest_parts")).alias("p"), F.explode(F.expr("sequence(0, n_parts - 1)")).alias("q"), F.lit(0).alias("side"))
    right = whole.join(cut, "star").select("star", "node", F.explode(F.expr("sequence(0, rest_parts - 1)")).alias("p"), _part(F.col("n_parts")).alias("q"), F.lit(1).alias("side"))
    unit = F.xxhash64("star", "p", "q")
    more = linked(left.unionByName(right).select(unit.alias("g"), unit.alias("unit"), "side", "node"), sets, percent)
    return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(shared.durable(more)))


def _verdict(rows: DataFrame, key: str, keep: tuple[str, ...]) -> DataFrame:
    component = F.when(F.col("doc").isNotNull(), F.coalesce("label", "low", "doc"))
    out = rows.select(F.col("doc").alias(key), *keep, "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_near_duplicates": op7_near_duplicates}
ORACLE = {
    "op7_near_duplicates": r"""
with recursive d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (
  select distinct doc_id, array_to_string(list_slice(ws, i, i + least(len(ws), 5) - 1), ' ') as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)),
e as (select a as u, b as v from links union all select b, a from links),
reach(u, v) as (select doc_id, doc_id from d union select reach.u, e.v from reach join e on reach.v = e.u),
c as (select u as doc_id, min(v) as component_id from reach group by u)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from d left join n using (doc_id) join c using (doc_id)""",
}
