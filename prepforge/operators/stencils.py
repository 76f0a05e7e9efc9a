"""Local operators on grids by blocks: a block of cells gets the cells around it once, and is worked on as arrays."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .joins import small
from .spatial import NEIGHBOURS

#: Cells on a side of a block, a power of two.
BITS = 7
SPAN = 1 << BITS


def number(n: int | str) -> Column:
    return F.col(n) if isinstance(n, str) else F.lit(n)


def _block(br: Column, bc: Column) -> Column:
    """The number of a block: one key, which sorts fast."""
    return F.shiftleft(br.cast("long"), 32).bitwiseOR(bc.cast("long"))


def _corner(t: pa.Table) -> tuple[int, int]:
    """First row and column of the block that t's rows lie in."""
    block = t.column("block")[0].as_py()
    return (block >> 32) * SPAN, (block & 0xFFFFFFFF) * SPAN


class Block:
    """A block with halo cells around: r0, c0 (its first row and column), h, w (the grid's rows and columns), here (which cells exist), and by name values and full (which are not null)."""

    def __init__(self, t: pa.Table, names: Sequence[str], halo: int, h: int, w: int):
        self.h, self.w, self.halo = h, w, halo
        self.r0, self.c0 = _corner(t)
        side = SPAN + 2 * halo
        row, col = (t.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        known = row >= 0
        at = (row[known] - self.r0 + halo, col[known] - self.c0 + halo)
        self.here = np.zeros((side, side), bool)
        self.here[at] = True
        self.values, self.full = {}, {}
        for n in names:
            v = np.zeros((side, side))
            some = ~pc.is_null(t.column(n)).to_numpy()[known]
            v[at] = np.where(some, t.column(n).to_numpy()[known].astype(float), 0.0)
            full = np.zeros((side, side), bool)
            full[at] = some
            self.values[n], self.full[n] = v, full

    def own(self, a: np.ndarray) -> np.ndarray:
        """The block's part of an array with halo."""
        return a[self.halo : self.halo + SPAN, self.halo : self.halo + SPAN]

    def inside(self, rim: int = 0) -> np.ndarray:
        """Which of the block's places lie in the grid, rim cells from its border at least."""
        r, c = np.arange(SPAN) + self.r0, np.arange(SPAN) + self.c0
        return ((r >= rim) & (r < self.h - rim))[:, None] & ((c >= rim) & (c < self.w - rim))

    def shifted(self, a: np.ndarray, dr: int, dc: int) -> np.ndarray:
        """The neighbours at (dr, dc) of the block's cells."""
        k = self.halo
        return a[k + dr : k + dr + SPAN, k + dc : k + dc + SPAN]

    def _places(self, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the places of an axis, halo included, take their values from if the grid is mirrored at its edges, and which do."""
        p = np.arange(-self.halo, SPAN + self.halo) + first
        of = np.where(p < 0, -p - 1, np.where(p >= n, 2 * n - 1 - p, p))
        ok = (of >= 0) & (of < n) & (p < n + self.halo)
        return np.clip(of - first + self.halo, 0, len(p) - 1), ok

    def mirrored(self, a: np.ndarray) -> np.ndarray:
        """a with the places beyond the grid as if it were mirrored at its edges; 0 where that gives nothing."""
        (r, row), (c, col) = self._places(self.r0, self.h), self._places(self.c0, self.w)
        return np.where(row[:, None] & col, a[np.ix_(r, c)], np.zeros(1, a.dtype))

    def weighted(self, steps: Sequence[tuple[str, Mapping[int, float]]], values: np.ndarray, full: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weighted sums over offsets along one axis after the other, mirrored at the edges: sums, which of the block's cells have any, and which exist as any cell that counts does."""
        v, f, e = self.mirrored(values), self.mirrored(full), self.mirrored(here)
        for axis, weights in steps:
            part = lambda a, o, axis=axis: a[self.halo + o : self.halo + o + SPAN] if axis == "row" else a[:, self.halo + o : self.halo + o + SPAN]
            v = sum(part(v, o) * w for o, w in weights.items())
            f, e = (np.logical_or.reduce([part(x, o) for o in weights]) for x in (f, e))
        for axis in {"row", "col"} - {a for a, _ in steps}:
            v, f, e = (x[self.halo : self.halo + SPAN] if axis == "row" else x[:, self.halo : self.halo + SPAN] for x in (v, f, e))
        return v, f, e & self.inside()


def on_blocks(cells: DataFrame, names: Sequence[str], nrows: int | str, ncols: int | str, halo: int, f: Callable[[Block], tuple[np.ndarray, dict]], out: str, by: Sequence[str] = (), every: bool = False) -> DataFrame:
    """by, row, col and the columns out of f of each block: which of its cells to return, and their values by name (masked: null).

    names are numeric columns of cells; nrows and ncols are numbers, or names of columns of by. every: blocks without cells are worked on too.
    """
    near = lambda c, n: F.explode(F.sequence(F.greatest(F.shiftright(F.col(c) - halo, BITS), F.lit(0)), F.least(F.shiftright(F.col(c) + halo, BITS), F.shiftright((number(n) - 1).cast("int"), BITS))))
    rows = cells.select(*by, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *names)
    rows = rows.filter((F.col("row") >= 0) & (F.col("row") < number(nrows)) & (F.col("col") >= 0) & (F.col("col") < number(ncols)))
    rows = rows.withColumn("br", near("row", nrows)).withColumn("bc", near("col", ncols))
    if every:
        grids = cells.select(*by).distinct() if by else cells.sparkSession.range(1)
        blocks = lambda n: F.explode(F.sequence(F.lit(0), F.shiftright((number(n) - 1).cast("int"), BITS)))
        marks = grids.filter((number(nrows) > 0) & (number(ncols) > 0)).withColumn("br", blocks(nrows)).withColumn("bc", blocks(ncols))
        rows = rows.unionByName(marks.select(*by, "br", "bc", F.lit(-1).alias("row"), F.lit(-1).alias("col")), allowMissingColumns=True)
    size = lambda t, n: t.column(n)[0].as_py() if isinstance(n, str) else n

    def run(t: pa.Table) -> pa.Table:
        b = Block(t, names, halo, size(t, nrows), size(t, ncols))
        keep, made = f(b)
        r, c = np.nonzero(keep)
        columns = {x: pa.repeat(t.column(x)[0], len(r)) for x in by}
        columns |= {"row": pa.array((r + b.r0).astype(np.int32)), "col": pa.array((c + b.c0).astype(np.int32))}
        for n, v in made.items():
            v = v[keep]
            columns[n] = pa.array(np.ma.getdata(v), mask=np.ma.getmaskarray(v)) if np.ma.isMaskedArray(v) else pa.array(v)
        return pa.table(columns)

    kinds = dict(cells.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in by) + f"row int, col int, {out}"
    return rows.withColumn("block", _block(F.col("br"), F.col("bc"))).drop("br", "bc").groupBy("block", *by).applyInArrow(run, schema)


def smoothed(cells: DataFrame, nrows: int | str, ncols: int | str, steps: Sequence[tuple[str, Mapping[int, float]]], value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """by, row, col and out: weighted sums over offsets along one axis after the other, mirrored at the edges."""
    halo = max(max(map(abs, w)) for _, w in steps)

    def f(b: Block):
        v, full, here = b.weighted(steps, b.values[value], b.full[value], b.here)
        return here, {out: np.ma.array(v, mask=~full)}

    return on_blocks(cells, [value], nrows, ncols, halo, f, f"`{out}` double", by)


#: Sobel's weights.
SMOOTH, DIFF = {-1: 1.0, 0: 2.0, 1: 1.0}, {-1: -1.0, 1: 1.0}


def sobel(b: Block, name: str, cell: float, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Slope of the block's cells, at least floor, and which have one."""
    held = b.values[name], b.full[name], b.here
    dx, fx, ex = b.weighted((("row", SMOOTH), ("col", DIFF)), *held)
    dy, fy, ey = b.weighted((("col", SMOOTH), ("row", DIFF)), *held)
    return np.where(fx & fy, np.maximum(np.hypot(dx / (8 * cell), dy / (8 * cell)), floor), floor), ex & ey


def steepest(b: Block, name: str) -> np.ndarray:
    """Code of the steepest of eight neighbours, the first in code order among equals; border and empty cells keep 0."""
    v, full = b.values[name], b.full[name]
    at, best, code = b.own(v), np.full((SPAN, SPAN), -np.inf), np.zeros((SPAN, SPAN), np.int32)
    for d, (dr, dc) in enumerate(NEIGHBOURS):
        fall = (at - b.shifted(v, dr, dc)) / np.hypot(dr, dc)
        fall = np.where(b.shifted(full, dr, dc), np.where(np.isnan(fall), np.inf, fall), -np.inf)
        code = np.where(fall > best, d, code)
        best = np.maximum(best, fall)
    return np.where(b.inside(1) & b.own(full), code, 0).astype(np.int32)


#: Points of a block that a task may hold.
MOST_POINTS = 2_000_000


def cell_percentiles(points: DataFrame, shares: Mapping[str, float], by: Sequence[str] = (), most: int = MOST_POINTS) -> DataFrame:
    """by, row, col and an exact percentile of z (interpolated, nulls left out) for each of shares (name to share).

    Points are sorted by blocks of cells; those of blocks with more than most points go cell by cell through Spark's own percentile.
    """
    keys = ["block", *by]
    row, col = (F.col(c).cast("int") for c in ("row", "col"))
    cell = F.shiftleft(row.bitwiseAND(F.lit(SPAN - 1)), BITS).bitwiseOR(col.bitwiseAND(F.lit(SPAN - 1)))
    placed = points.select(_block(F.shiftright(row, BITS), F.shiftright(col, BITS)).alias("block"), *by, cell.cast("short").alias("cell"), "z")
    dense = durable(placed.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > most).select(F.struct(*keys).alias("__block")))
    block = F.struct(*keys)  # of structs, nulls are equal in joins

    def run(t: pa.Table) -> pa.Table:
        cell, z, null = t.column("cell").to_numpy(), t.column("z").to_numpy().astype(float), pc.is_null(t.column("z")).to_numpy()
        order = np.lexsort((z, null)) if null.any() else np.argsort(z)
        order = order[np.argsort(cell[order], kind="stable")]  # of short numbers: a radix sort
        cell, z, null = cell[order], z[order], null[order]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        n = np.add.reduceat((~null).astype(np.int64), first)
        columns = {x: pa.repeat(t.column(x)[0], len(first)) for x in by}
        r0, c0 = _corner(t)
        columns |= {"row": pa.array((r0 + (cell[first] >> BITS)).astype(np.int32)), "col": pa.array((c0 + (cell[first] & (SPAN - 1))).astype(np.int32))}
        for name, share in shares.items():
            p = (np.maximum(n, 1) - 1) * share
            low, high = np.floor(p), np.ceil(p)
            a, b = z[first + low.astype(np.int64)], z[first + high.astype(np.int64)]
            columns[name] = pa.array(np.where((a == b) | (low == high), a, (high - p) * a + (p - low) * b), mask=n == 0)
        return pa.table(columns)

    kinds = dict(points.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in by) + "row int, col int, " + ", ".join(f"`{n}` double" for n in shares)
    sparse = placed
    if some := not dense.isEmpty():
        sparse = placed.join(small(dense), block == F.col("__block"), "left_anti")
    made = sparse.groupBy(*keys).applyInArrow(run, schema)
    if not some:
        return made
    packed = placed.join(small(dense), block == F.col("__block"), "left_semi")
    at = {"row": F.shiftright("block", 32) * SPAN + F.shiftright("cell", BITS), "col": F.col("block").bitwiseAND(F.lit(0xFFFFFFFF)) * SPAN + F.col("cell").bitwiseAND(F.lit(SPAN - 1))}
    packed = packed.withColumns({n: c.cast("int") for n, c in at.items()})
    return made.unionByName(packed.groupBy(*by, "row", "col").agg(*[F.percentile("z", x).alias(n) for n, x in shares.items()]))


#: How far a block looks for filled cells by itself.
REACH = 4


def near_filled(b: Block, name: str, k: int, power: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's cells with empty ones filled by the inverse-distance mean of the k nearest filled cells, which of them are filled, and which lie too far from k cells."""
    v, full = b.values[name].copy(), b.full[name]
    r, c = np.nonzero(b.inside() & ~b.own(full))
    todo, got = np.arange(len(r)), np.zeros(len(r), int)
    top, low = np.zeros(len(r)), np.zeros(len(r))
    ways = sorted((dr * dr + dc * dc, dr, dc) for dr in range(-REACH, REACH + 1) for dc in range(-REACH, REACH + 1) if 0 < dr * dr + dc * dc <= REACH * REACH)
    for d2, dr, dc in ways:
        if not len(todo):
            break
        at = (r[todo] + b.halo + dr, c[todo] + b.halo + dc)
        some = full[at]
        w = 1 / max(d2**0.5, 1e-6) ** power
        top[todo] += np.where(some, w * v[at], 0.0)
        low[todo] += np.where(some, w, 0.0)
        got[todo] += some
        todo = todo[got[todo] < k]
    done = np.ones(len(r), bool)
    done[todo] = False
    values, filled, far = b.own(v).copy(), b.own(full).copy(), np.zeros((SPAN, SPAN), bool)
    values[r[done], c[done]] = top[done] / low[done]
    filled[r[done], c[done]] = True
    far[r[~done], c[~done]] = True
    return values, filled, far
