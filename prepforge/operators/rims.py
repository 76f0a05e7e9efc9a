"""Depressions, flow accumulation and least-cost distances on grids of any size: tiles are solved once, their rims form a graph.

A first pass packs cells into tiles with a rim of neighbours, a second solves each tile into what its rim cells are to each other, a third
finishes each tile once its rim is known. In between only rim cells travel. Tiles are packed and worked on by blocks, small ones as one stack.

- Depressions: spill heights. A tile's cells are flooded from its rim cells; where two floods meet they spill, and a spanning forest of these
  spills holds all that others need. Groups of FAN x FAN tiles (then of groups) contract their forests to their own rims, up to the whole
  grid, whose only way out is the border; levels go down again the same way.
- Accumulation: drained sums. What enters a tile leaves it at one cell, or stays. These exits form a forest, which is contracted by the same
  groups, and summed up going down.
- Least cost: a group of blocks settles its cells from the rim cells' values that it has or is given, and passes on what leaves it; only
  groups that are given a better value work again, so rounds follow the groups that a path crosses. Only rim cells' values are kept.

Tables may hold many grids: `by` names the columns that tell them apart (a village, say); every grouping and join has them, so all grids are
worked on together, and a grid that is settled sends nothing more. Cells are (row, col, value) from 0; a missing or null cell is empty.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .joins import small
from .spatial import NEIGHBOURS

TILE, FAN = 128, 8
#: Least cost goes by blocks of such tiles, and groups of so many blocks on a side.
COST_TILE, COST_FAN = 32, 4
#: Cells on a side of the block of tiles that a task works on at once: small tiles are stacked, larger ones stand alone.
BLOCK = 128
#: The way out of a grid, beside the cells' numbers (row and column in 32 bits each).
OUT = -1


def _row(c: str) -> Column:
    return F.shiftright(F.col(c), 32)


def _col(c: str) -> Column:
    return F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))


def _types(df: DataFrame, by: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{c}` {kinds[c]}, " for c in by)


def block_side(tile: int) -> int:
    """Cells on a side of a block: whole tiles."""
    return tile * max(1, BLOCK // tile)


def with_rims(cells: DataFrame, span: int) -> DataFrame:
    """Cells in their own block (br, bc) and in each block whose rim they lie on."""
    near = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + o) / span).cast("int") for o in (-1, 0, 1)]))
    return cells.withColumn("br", F.explode(near("row"))).withColumn("bc", F.explode(near("col")))


class Tiles:
    """The tiles of a block that have cells, as stacks (tile, row, column), each with a rim of one cell: layers by name (empty: nan), here (which cells exist), own (those of the tile itself)."""

    def __init__(self, row, names: Sequence[str], tile: int):
        side, span = tile + 2, block_side(tile)
        a = np.frombuffer(pa.decompress(row.body, decompressed_size=8 * (len(names) + 1) * (span + 2) ** 2, codec="zstd", asbytes=True)).reshape(-1, span + 2, span + 2)
        across = span // tile
        a = np.lib.stride_tricks.sliding_window_view(a, (side, side), (1, 2))[:, ::tile, ::tile].reshape(len(names) + 1, across * across, side, side)
        some = np.flatnonzero((a[0, :, 1:-1, 1:-1] == 1).any(axis=(1, 2)))
        a = a[:, some]
        self.layers = dict(zip(names, a[1:], strict=True))
        self.here = a[0] == 1
        inside = np.zeros((side, side), bool)
        inside[1:-1, 1:-1] = True
        self.own, self.tile, self.h, self.w = self.here & inside, tile, int(row.h), int(row.w)
        #: Numbers of the tiles, and where each is in the stacks.
        self.tr, self.tc = int(row.br) * across + some // across, int(row.bc) * across + some % across
        self.at = np.full(across * across, -1)
        self.at[some] = np.arange(len(some))
        self.r0, self.c0, self.across, self.span = int(row.br) * span, int(row.bc) * span, across, span
        r, c = np.indices((side, side))
        rows, cols = r + (self.tr * tile - 1)[:, None, None], c + (self.tc * tile - 1)[:, None, None]
        self.id = rows.astype(np.int64) << 32 | cols
        self.border = (rows == 0) | (cols == 0) | (rows == self.h) | (cols == self.w)
        self.edge = np.broadcast_to((r == 1) | (c == 1) | (r == tile) | (c == tile), self.own.shape)

    def cells(self, name: str, values: np.ndarray, carry: dict[str, str] | None = None) -> pd.DataFrame:
        """carry: layers (name in the result, and here) that come along."""
        i = self.id[self.own]
        return pd.DataFrame({"row": (i >> 32).astype(np.int32), "col": (i & 0xFFFFFFFF).astype(np.int32), name: values[self.own]} | {n: self.layers[c][self.own] for n, c in (carry or {}).items()})

    def place(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tile, row and column in the stacks of cells of the block."""
        r, c = (ids >> 32) - self.r0, (ids & 0xFFFFFFFF) - self.c0
        return self.at[r // self.tile * self.across + c // self.tile], r % self.tile + 1, c % self.tile + 1


def _ways(dr: int, dc: int, h: int, w: int) -> tuple[tuple, tuple]:
    """Slices of the cells that have a neighbour at (dr, dc), and of these neighbours."""
    here = (..., slice(max(0, -dr), h - max(0, dr)), slice(max(0, -dc), w - max(0, dc)))
    return here, (..., slice(max(0, dr), h + min(0, dr)), slice(max(0, dc), w + min(0, dc)))


def shifted(a: np.ndarray, dr: int, dc: int, fill) -> np.ndarray:
    """Value of the neighbour at (dr, dc) of each cell."""
    out = np.full(a.shape, fill, a.dtype)
    h, w = a.shape[-2:]
    out[..., max(0, -dr) : h - max(0, dr), max(0, -dc) : w - max(0, dc)] = a[..., max(0, dr) : h + min(0, dr), max(0, dc) : w + min(0, dc)]
    return out


def tiled(cells: DataFrame, names: Sequence[str], by: Sequence[str], tile: int) -> DataFrame:
    """by, br, bc, h, w (the last row and column of the grid) and body of each block of tiles that has cells; written once."""
    size = cells.groupBy(*by).agg(F.max("row").alias("h"), F.max("col").alias("w"))
    sized = cells.join(small(durable(size)), list(by)) if by else cells.crossJoin(F.broadcast(size))  # one row for each grid
    keys, span = [*by, "br", "bc"], block_side(tile)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf["row"].to_numpy(np.int64) - (int(pdf["br"].iloc[0]) * span - 1)
        c = pdf["col"].to_numpy(np.int64) - (int(pdf["bc"].iloc[0]) * span - 1)
        if not ((r > 0) & (c > 0) & (r <= span) & (c <= span)).any():
            return pd.DataFrame(columns=[*keys, "h", "w", "body"])
        a = np.full((len(names) + 1, span + 2, span + 2), np.nan)
        a[0, r, c] = 1
        for k, name in enumerate(names, 1):
            a[k, r, c] = pdf[name].to_numpy(dtype=float, na_value=np.nan)
        out = pdf[[*keys, "h", "w"]].iloc[:1].copy()
        out["body"] = [pa.compress(a.tobytes(), codec="zstd", asbytes=True)]
        return out

    rows = with_rims(sized.select(*by, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), *[F.col(n).cast("double").alias(n) for n in names]), span)
    return durable(rows.groupBy(*keys).applyInPandas(pack, f"{_types(cells, by)}br int, bc int, h int, w int, body binary"))


def _each(tiles: DataFrame, by: Sequence[str], names: Sequence[str], tile: int, f: Callable[[Tiles], pd.DataFrame], schema: str) -> DataFrame:
    """f of every block of tiles, with the columns by."""

    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                out = f(Tiles(row, names, tile))
                for c in by:
                    out[c] = getattr(row, c)
                yield out

    return tiles.mapInPandas(run, _types(tiles, by) + schema)


def _finished(tiles: DataFrame, rims: DataFrame, by: Sequence[str], names: Sequence[str], tile: int, f: Callable[[Tiles, pd.DataFrame], pd.DataFrame], *made: str) -> DataFrame:
    """by, row, col and made from f of every block of tiles and the rows of rims (by, node, ...) whose node lies in it."""
    keys = [*by, "br", "bc"]
    placed = _in_group(rims, "node", block_side(tile), "br", "bc")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=[*by, "row", "col", *made])
        row = next(left.itertuples(index=False))
        out = f(Tiles(row, names, tile), right)
        for c in by:
            out[c] = getattr(row, c)
        return out

    return tiles.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInPandas(run, f"{_types(tiles, by)}row int, col int, " + ", ".join(f"{n} double" for n in made))


def _in_group(df: DataFrame, node: str, span: int, r: str = "gr", c: str = "gc") -> DataFrame:
    return df.withColumns({r: F.floor(_row(node) / span).cast("int"), c: F.floor(_col(node) / span).cast("int")})


# --- depressions -------------------------------------------------------------------------------------------------------------------------


def _flood(z: np.ndarray, free: np.ndarray, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each tile of a stack: least highest point of a path from any source to each free cell, and the place of such a source in the flat array (-1: none)."""
    w = np.where(sources, z, np.inf)
    label = np.where(sources, np.arange(z.size).reshape(z.shape), -1)
    ways = [_ways(dr, dc, *z.shape[-2:]) for dr, dc in NEIGHBOURS]
    todo = np.arange(len(z))
    while len(todo):
        # only tiles that still change
        zs, own, ws, of = z[todo], free[todo], w[todo], label[todo]
        for here, there in ways:
            through = np.maximum(zs[here], ws[there])
            better = own[here] & (through < ws[here])
            ws[here], of[here] = np.where(better, through, ws[here]), np.where(better, of[there], of[here])
        moved = (ws != w[todo]).any(axis=(1, 2))
        w[todo], label[todo] = ws, of
        todo = todo[moved]
    return w, label


def _forest(a: np.ndarray, b: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the edges of a spanning forest of least heights."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    kept = []
    for i in np.argsort(h, kind="stable").tolist():
        x, y = top(int(a[i])), top(int(b[i]))
        if x != y:
            up[x] = y
            kept.append(i)
    return np.array(kept, np.int64)


def _least(a: np.ndarray, b: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Undirected edges once, with their least height."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((h, b, a))
    a, b, h = a[order], b[order], h[order]
    first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    return a[first], b[first], h[first]


def _spills(t: Tiles) -> pd.DataFrame:
    """a, b, h: forest of the spills between the rim cells of each tile, edges to rim cells of other tiles, and ways out at the border."""
    z = t.layers["z"]
    free = t.own & ~np.isnan(z)
    rim = free & (t.edge | t.border)
    w, label = _flood(np.where(free, z, np.inf), free, rim)
    a, b, h = [], [], []
    flat = t.id.ravel()
    for dr, dc in NEIGHBOURS[:4]:
        other, height = shifted(label, dr, dc, -1), np.maximum(w, shifted(w, dr, dc, np.inf))
        meet = (label >= 0) & (other >= 0) & (label != other)
        a.append(flat[label[meet]])
        b.append(flat[other[meet]])
        h.append(height[meet])
    a, b, h = _least(*(np.concatenate(x) for x in (a, b, h)))
    kept = _forest(a, b, h)
    parts = [(a[kept], b[kept], h[kept]), (t.id[rim & t.border], np.full(int((rim & t.border).sum()), OUT), z[rim & t.border])]
    halo = t.here & ~t.own & ~np.isnan(z)
    for dr, dc in NEIGHBOURS:
        over = free & shifted(halo, dr, dc, False) & (t.id < shifted(t.id, dr, dc, 0))  # noqa: FBT003  told by the tile of the smaller number
        parts.append((t.id[over], shifted(t.id, dr, dc, 0)[over], np.maximum(z, shifted(z, dr, dc, np.nan))[over]))
    return pd.DataFrame({c: np.concatenate([p[k] for p in parts]) for k, c in enumerate("abh")})


def _contracted(pdf: pd.DataFrame) -> pd.DataFrame:
    """A group's edges (kind 0) and outer cells (kind 1) as: forest between the outer cells and the way out (kind 0), and for every inner cell the outer cell that floods it, and how high (kind 1)."""
    e = pdf[pdf["kind"] == 0]
    sources = {OUT, *pdf.loc[pdf["kind"] == 1, "a"].tolist()}
    near: dict[int, list[tuple[int, float]]] = {}
    for x, y, h in zip(e["a"].tolist(), e["b"].tolist(), e["h"].tolist(), strict=True):
        near.setdefault(x, []).append((y, h))
        near.setdefault(y, []).append((x, h))
    level, label = dict.fromkeys(sources, -math.inf), {s: s for s in sources}
    heap = [(-math.inf, s) for s in sorted(sources)]
    done = set()
    while heap:
        w, x = heapq.heappop(heap)
        if x in done:
            continue
        done.add(x)
        for y, h in near.get(x, ()):
            if (up := max(w, h)) < level.get(y, math.inf):
                level[y], label[y] = up, label[x]
                heapq.heappush(heap, (up, y))
    out = [(1, x, label.get(x, OUT), level.get(x, math.inf)) for x in near if x not in sources]
    a, b, h = e["a"].to_numpy(), e["b"].to_numpy(), e["h"].to_numpy()
    la, lb = (np.array([label.get(x, OUT) for x in v.tolist()], np.int64) for v in (a, b))
    height = np.array([max(level.get(x, math.inf), level.get(y, math.inf), z) for x, y, z in zip(a.tolist(), b.tolist(), h.tolist(), strict=True)])
    meet = (la != lb) & (height < math.inf)
    a, b, h = _least(la[meet], lb[meet], height[meet])
    kept = _forest(a, b, h)
    frame = pd.DataFrame(out, columns=["kind", "a", "b", "h"])
    return pd.concat([frame, pd.DataFrame({"kind": 0, "a": a[kept], "b": b[kept], "h": h[kept]})], ignore_index=True).astype({"kind": "int32", "a": "int64", "b": "int64", "h": "float64"})


def _grouped(f: Callable[[pd.DataFrame], pd.DataFrame], by: Sequence[str], keys: Sequence[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """f with the group's columns by (and more keys) on its rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = f(pdf)
        for c in [*by, *keys]:
            out[c] = pdf[c].iloc[0]
        return out

    return run


def _flooded(edges: DataFrame, by: Sequence[str], span: int) -> DataFrame:
    """by, node, level of all cells in edges (by, a, b, h): the least highest spill on a way out (infinite, if there is none)."""
    levels, kinds = [], _types(edges, by)
    while True:
        e = _in_group(_in_group(edges, "a", span), "b", span, "br", "bc")
        same = (F.col("b") == OUT) | (F.col("a") == OUT) | ((F.col("gr") == F.col("br")) & (F.col("gc") == F.col("bc")))
        e = e.withColumns({"gr": F.when(F.col("a") == OUT, F.col("br")).otherwise(F.col("gr")), "gc": F.when(F.col("a") == OUT, F.col("bc")).otherwise(F.col("gc"))})
        cross = e.filter(~same)
        outer = cross.select(*by, F.col("gr"), F.col("gc"), "a").union(cross.select(*by, "br", "bc", "b")).distinct()
        work = e.filter(same).select(*by, "gr", "gc", F.lit(0).alias("kind"), "a", "b", "h").unionByName(outer.withColumns({"kind": F.lit(1), "b": F.lit(OUT).cast("long"), "h": F.lit(0.0)}))
        made = durable(work.groupBy(*by, "gr", "gc").applyInPandas(_grouped(_contracted, by, ()), f"{kinds}kind int, a long, b long, h double"))
        levels.append(made.filter("kind = 1").select(*by, F.col("a").alias("node"), "b", "h"))
        rest = cross.select(*by, "a", "b", "h")
        if rest.isEmpty():
            break
        edges, span = durable(made.filter("kind = 0").select(*by, "a", "b", "h").unionByName(rest)), span * FAN
    known = None
    for nodes in reversed(levels):
        own = nodes
        if known is not None:
            above = known.select(*by, F.col("node").alias("b"), "level")
            own = nodes.join(above, [*by, "b"], "left")
        else:
            own = nodes.withColumn("level", F.lit(None).cast("double"))
        new = own.select(*by, "node", F.greatest("h", "level").alias("level"))  # the way out has no level, and greatest leaves nulls out
        known = durable(new if known is None else known.unionByName(new))
    return known


def fill_depressions(cells: DataFrame, tile: int = TILE, by: Sequence[str] = ()) -> DataFrame:
    """Each cell's lowest possible highest point of a path from the border; empty cells block, cut-off cells keep their value."""
    tiles = tiled(cells.withColumnRenamed("value", "z"), ["z"], by, tile)
    rims = _flooded(durable(_each(tiles, by, ["z"], tile, _spills, "a long, b long, h double")), by, tile * FAN)

    def finish(t: Tiles, known: pd.DataFrame) -> pd.DataFrame:
        z = t.layers["z"]
        free = t.own & ~np.isnan(z)
        w, label = _flood(np.where(free, z, np.inf), free, free & (t.edge | t.border))
        level = np.full(z.shape, np.inf)
        level[t.place(known["node"].to_numpy())] = known["level"].to_numpy()
        at = np.where(label >= 0, level.ravel()[label], np.inf)
        filled = np.maximum(w, at)
        return t.cells("value", np.where(np.isfinite(filled), filled, z))

    return _finished(tiles, rims, by, ["z"], tile, finish, "value")


# --- accumulation ------------------------------------------------------------------------------------------------------------------------


class _Flow:
    """Where a tile's cells drain to. A cell is visited before its target if it is higher, or as high and further on in the grid; else it is late, and passes nothing on."""

    def __init__(self, t: Tiles):
        z, d = t.layers["z"], t.layers["d"]
        sends = t.here & ~np.isnan(z)
        side = z.shape[2]
        self.target = np.full(z.shape, -1)
        self.early = np.zeros(z.shape, bool)
        place = np.arange(z.size).reshape(z.shape)
        for code, (dr, dc) in enumerate(NEIGHBOURS):
            to = sends & (d == code) & shifted(t.here, dr, dc, False)  # noqa: FBT003
            zt = shifted(z, dr, dc, np.nan)
            late = np.isnan(zt) | (z < zt) | ((z == zt) & ((dr > 0) | ((dr == 0) & (dc > 0))))
            self.target = np.where(to, place + dr * side + dc, self.target)
            self.early = np.where(to, ~late, self.early)
        own = t.own.ravel()
        at = np.flatnonzero(own & (self.target.ravel() >= 0))
        to = self.target.ravel()[at]
        #: Cells with a target in the tile, and those whose target is another tile's.
        self.inside, self.out = at[own[to]], at[~own[to]]
        self.t = t

    def sums(self, start: np.ndarray) -> np.ndarray:
        """What each own cell passes on, from what each has at first: start and what earlier cells pass to it."""
        target, early = self.target.ravel(), self.early.ravel()
        at = self.inside[early[self.inside]]
        waits = np.bincount(target[at], minlength=start.size)
        total, passes = start.copy(), np.zeros(start.size, bool)
        passes[at] = True
        ready = np.flatnonzero(passes & (waits == 0))
        while len(ready):
            to = target[ready]
            np.add.at(total, to, total[ready])
            np.subtract.at(waits, to, 1)
            to = np.unique(to)
            ready = to[(waits[to] == 0) & passes[to]]
        return total

    def exits(self) -> np.ndarray:
        """The last cell of the tile on the way of what enters a cell."""
        target, early = self.target.ravel(), self.early.ravel()
        to = np.arange(target.size)
        at = self.inside[early[self.inside]]
        to[at] = target[at]
        while not ((up := to[to]) == to).all():
            to = up
        return to


def _drains(t: Tiles) -> pd.DataFrame:
    """kind 0: cell u gives to v of another tile (early or not), and has a from its own tile; kind 1: what enters u leaves the tile at v."""
    flow = _Flow(t)
    ids, target, early = t.id.ravel(), flow.target.ravel(), flow.early.ravel()
    total = flow.sums(t.own.ravel().astype(float))
    leave = np.zeros(ids.size, bool)
    leave[flow.out] = True
    rim = np.flatnonzero((t.own & t.edge).ravel())
    at = flow.exits()[rim]
    rim, at = rim[leave[at]], at[leave[at]]
    out = flow.out
    return pd.DataFrame({"kind": np.repeat([0, 1], [len(out), len(rim)]).astype(np.int32), "u": np.r_[ids[out], ids[rim]], "v": np.r_[ids[target[out]], ids[at]], "early": np.r_[early[out], np.zeros(len(rim), bool)], "a": np.r_[total[out], np.zeros(len(rim))]})


def _tops(pdf: pd.DataFrame) -> pd.DataFrame:
    """x, top (the last of x's line whose parent is not in the group) and the sum of a over all x of one top, on the top's own row."""
    parent = {x: p for x, p in zip(pdf["x"].tolist(), pdf["inner"].tolist(), strict=True) if p != OUT}
    top: dict[int, int] = {}
    for x in pdf["x"].tolist():
        line = [x]
        while line[-1] not in top and line[-1] in parent:
            line.append(parent[line[-1]])
        end = top.get(line[-1], line[-1])
        for y in line:
            top[y] = end
    sums: dict[int, float] = {}
    for x, a in zip(pdf["x"].tolist(), pdf["a"].tolist(), strict=True):
        sums[top[x]] = sums.get(top[x], 0.0) + a
    xs = pdf["x"].tolist()
    return pd.DataFrame({"x": np.array(xs, np.int64), "top": np.array([top[x] for x in xs], np.int64), "sum": [sums.get(x, 0.0) if top[x] == x else 0.0 for x in xs]})


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    """x and total: a, and the totals of all whose parent is x in the group."""
    xs, total = pdf["x"].tolist(), dict(zip(pdf["x"].tolist(), pdf["a"].tolist(), strict=True))
    parent = {x: p for x, p in zip(xs, pdf["inner"].tolist(), strict=True) if p != OUT}
    waits: dict[int, int] = {}
    for p in parent.values():
        waits[p] = waits.get(p, 0) + 1
    ready = [x for x in xs if not waits.get(x)]
    while ready:
        x = ready.pop()
        if (p := parent.get(x)) is not None:
            total[p] += total[x]
            waits[p] -= 1
            if not waits[p]:
                ready.append(p)
    return pd.DataFrame({"x": np.array(xs, np.int64), "total": [total[x] for x in xs]})


def _forest_sums(nodes: DataFrame, by: Sequence[str], span: int) -> DataFrame:
    """by, x, total of a forest (by, x, parent or null, a): a summed over each node and all below it."""
    kinds, levels = _types(nodes, by), []
    outside = F.col("parent").isNotNull() & (F.col("inner") == OUT)
    while True:
        n = _in_group(_in_group(nodes, "x", span), "parent", span, "pr", "pc")
        inner = F.coalesce(F.when((F.col("gr") == F.col("pr")) & (F.col("gc") == F.col("pc")), F.col("parent")), F.lit(OUT))
        n = durable(n.select(*by, "gr", "gc", "x", "parent", "a", inner.alias("inner")))
        levels.append(n)
        over = n.filter(outside)
        if over.isEmpty():
            break
        tops = durable(n.groupBy(*by, "gr", "gc").applyInPandas(_grouped(_tops, by, ()), f"{kinds}x long, top long, sum double"))
        # the next level: tops that give to another group, or take from one
        taking = over.select(*by, F.col("x").alias("from"), F.col("parent").alias("x")).join(tops.select(*by, "x", "top"), [*by, "x"])
        gives = taking.select(*by, F.col("from").alias("x"), F.col("top").alias("parent"))
        takes = taking.select(*by, F.col("top").alias("x")).distinct()
        kept = takes.unionByName(gives.select(*by, "x")).distinct().join(gives, [*by, "x"], "left")
        nodes, span = durable(kept.join(tops.select(*by, "x", F.col("sum").alias("a")), [*by, "x"])), span * FAN
    total = None
    for n in reversed(levels):
        given = n
        if total is not None:
            over = n.filter(outside).select(*by, "x", "parent").join(total, [*by, "x"])
            inflow = over.groupBy(*by, F.col("parent").alias("x")).agg(F.sum("total").alias("inflow"))
            given = n.join(inflow, [*by, "x"], "left").withColumn("a", F.col("a") + F.coalesce("inflow", F.lit(0.0)))
        total = durable(given.groupBy(*by, "gr", "gc").applyInPandas(_grouped(_summed, by, ()), f"{kinds}x long, total double"))
    return total


def flow_accumulation(directed: DataFrame, tile: int = TILE, by: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """row, col, acc from (row, col, value, d). Cells are visited by falling height (then falling row and column): a cell passes what it has
    then to its target; what reaches it later stays. Empty cells send nothing. With carry, value and these columns (without nulls) come along."""
    names = ["z", "d", *carry]
    along = {"value": "z", **{c: c for c in carry}} if carry else {}
    tiles = tiled(directed.withColumnRenamed("value", "z"), names, by, tile)
    made = durable(_each(tiles, by, names, tile, _drains, "kind int, u long, v long, early boolean, a double"))
    gives = made.filter("kind = 0").select(*by, F.col("u").alias("x"), "v", "early", "a")
    exits = made.filter("kind = 1").select(*by, F.col("u").alias("v"), F.col("v").alias("parent"), F.lit(True).alias("early"))
    totals = _forest_sums(gives.join(exits, [*by, "v", "early"], "left").select(*by, "x", "parent", "a"), by, tile * FAN)
    inflow = gives.join(totals, [*by, "x"]).groupBy(*by, F.col("v").alias("node")).agg(F.sum(F.when(F.col("early"), F.col("total"))).alias("early"), F.sum(F.when(~F.col("early"), F.col("total"))).alias("late"))

    def finish(t: Tiles, given: pd.DataFrame) -> pd.DataFrame:
        flow, at = _Flow(t), t.place(given["node"].to_numpy())
        start, late = t.own.astype(float), np.zeros(t.own.shape)
        start[at] += given["early"].fillna(0.0).to_numpy()
        late[at] = given["late"].fillna(0.0).to_numpy()
        a = flow.sums(start.ravel())
        some = flow.inside[~flow.early.ravel()[flow.inside]]
        out = a + late.ravel()
        np.add.at(out, flow.target.ravel()[some], a[some])
        return t.cells("acc", out.reshape(t.own.shape), along)

    return _finished(tiles, inflow, by, names, tile, finish, "acc", *along)


# --- least cost --------------------------------------------------------------------------------------------------------------------------


def _steps(cost: np.ndarray, free: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """For each neighbour direction what a step costs, infinite where there is none."""
    out = []
    for dr, dc in NEIGHBOURS:
        ok = free & shifted(free, dr, dc, False)  # noqa: FBT003
        out.append((dr, dc, np.where(ok, (cost + shifted(cost, dr, dc, np.nan)) / 2 * math.hypot(dr, dc), np.inf)))
    return out


def _relaxed(d: np.ndarray, steps: list) -> np.ndarray:
    """Distances (of many sources or tiles at once, if d has three axes) after all shorter ways are taken."""
    d = d.copy()
    while True:
        before = d.copy()
        for dr, dc, s in steps:
            here, there = _ways(dr, dc, *d.shape[-2:])
            d[here] = np.minimum(d[here], d[there] + s[here])
        if (before == d).all():
            return d


def _settle(blocks: list[Tiles], start: dict[int, float]) -> tuple[dict[int, float], dict[int, float]]:
    """Distances of the rim cells (and the outlet) of a group's blocks from those known, and those of cells of other groups by a step over the group's edge. The block that is given the nearest value is worked on first."""
    place, moves, free, d, nearest, met = {}, [], [], [], {}, {}
    for k, t in enumerate(blocks):
        cost, own = t.layers["cost"][0], t.own[0]
        known = t.here[0] & ~np.isnan(cost)
        place[t.tr[0], t.tc[0]] = k
        # steps between own cells, and from these over the edge
        moves.append([(dr, dc, s, np.where(own, s, np.inf)) for dr, dc, s in _steps(cost, known)])
        free.append(known & own)
        d.append(np.full(cost.shape, np.inf))

    def offer(node: int, value: float) -> None:
        r, c = node >> 32, node & 0xFFFFFFFF
        t = blocks[0]
        k = place.get((r // t.tile, c // t.tile))
        if k is None:
            met[node] = min(value, met.get(node, np.inf))
            return
        at = r % t.tile + 1, c % t.tile + 1
        if free[k][at] and value < d[k][at]:
            d[k][at] = value
            nearest[k] = min(value, nearest.get(k, np.inf))
            fresh.setdefault(k, []).append(at)

    fresh: dict[int, list] = {}
    for node, value in start.items():
        offer(node, value)
    while nearest:
        k = min(nearest, key=nearest.get)
        del nearest[k]
        t, own = blocks[k], blocks[k].own[0]
        changed = np.zeros(own.shape, bool)
        changed[tuple(np.array(fresh.pop(k)).T)] = True
        edge = _relax_from(d[k], moves[k], changed)
        ids = t.id[0]
        over = np.full(own.shape, np.inf)
        source = np.where(own & edge, d[k], np.inf)
        for dr, dc, s, _ in moves[k]:
            here, there = _ways(dr, dc, *own.shape)
            over[here] = np.minimum(over[here], source[there] + s[here])
        at = ~own & np.isfinite(over)
        for node, value in zip(ids[at].tolist(), over[at].tolist(), strict=True):
            offer(node, value)
    rim = {}
    for t, v in zip(blocks, d, strict=True):
        at = t.own[0] & (t.edge[0] | np.isin(t.id[0], list(start))) & np.isfinite(v)
        rim |= zip(t.id[0][at].tolist(), v[at].tolist(), strict=True)
    return rim, met


def _relax_from(d: np.ndarray, moves: list, changed: np.ndarray) -> np.ndarray:
    """d with all shorter ways from the changed cells taken, in place, within the box of what changes; which cells changed."""
    every = changed.copy()
    while changed.any():
        rows, cols = np.flatnonzero(changed.any(axis=1)), np.flatnonzero(changed.any(axis=0))
        box = slice(max(rows[0] - 1, 0), rows[-1] + 2), slice(max(cols[0] - 1, 0), cols[-1] + 2)
        v, before = d[box], d[box].copy()
        for dr, dc, _, s in moves:
            here, there = _ways(dr, dc, *v.shape)
            np.minimum(v[here], v[there] + s[box][here], out=v[here])
        changed = np.zeros(d.shape, bool)
        changed[box] = v < before
        every |= changed
    return every


def settled_rims(cost: DataFrame, outlets: DataFrame, tile: int, by: Sequence[str] = (), fan: int = COST_FAN) -> tuple[DataFrame, DataFrame]:
    """Blocks of cost of tile cells on a side, and by, node, dist of their rim cells (and outlets). Blocks are settled by groups of fan x fan."""
    tiles = tiled(cost, ["cost"], by, tile)
    node = (F.col("row").cast("long") * (1 << 32) + F.col("col")).alias("node")
    ends = durable(outlets.select(*by, node))
    span, kinds = tile * fan, _types(tiles, by)
    keys = [*by, "gr", "gc"]
    group = lambda c: F.floor(F.col(c) / fan).cast("int")
    grouped = tiles.withColumns({"gr": group("br"), "gc": group("bc")})

    def settle(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[*keys, "node", "dist", "over"])
        start = right.groupby("node")["dist"].min().to_dict()
        known, met = _settle([Tiles(r, ["cost"], tile) for r in left.itertuples(index=False)], start)
        out = pd.DataFrame({"node": np.array([*known, *met], np.int64), "dist": np.array([*known.values(), *met.values()], float), "over": np.repeat([False, True], [len(known), len(met)])})
        for c in keys:
            out[c] = left[c].iloc[0]
        return out

    schema = f"{kinds}gr int, gc int, node long, dist double, over boolean"
    given = durable(_in_group(ends.withColumns({"dist": F.lit(0.0), "over": F.lit(True)}), "node", span).select(*keys, "node", "dist", "over"))
    state = given.limit(0)
    while True:
        active = durable(given.select(*keys).distinct())
        work = state.join(active, keys, "left_semi").unionByName(given)
        made = durable(grouped.join(small(active), keys, "left_semi").groupBy(*keys).cogroup(work.groupBy(*keys)).applyInPandas(settle, schema))
        state = durable(state.join(active, keys, "left_anti").unionByName(made.filter("not over")))
        # what leaves a group counts where it is less than what is known there
        sent = made.filter("over").groupBy(*by, "node").agg(F.min("dist").alias("dist"))
        better = sent.join(state.select(*by, "node", F.col("dist").alias("old")), [*by, "node"], "left").filter("old is null or dist < old")
        given = durable(_in_group(better, "node", span).select(*keys, "node", "dist", F.lit(True).alias("over")))
        if given.isEmpty():
            break

    return tiles, state.select(*by, "node", "dist")


def least_cost(cost: DataFrame, outlets: DataFrame, tile: int = COST_TILE, by: Sequence[str] = (), fan: int = COST_FAN) -> DataFrame:
    """row, col, dist of every cell to the outlet of its grid (by, row, col; one for each grid): steps cost the mean of both cells times their distance."""
    tile = block_side(tile)
    tiles, rims = settled_rims(cost, outlets, tile, by, fan)
    return _finished(tiles, rims, by, ["cost"], tile, lambda t, known: t.cells("dist", _block_distances(t, known)), "dist")


def _block_distances(t: Tiles, known: pd.DataFrame) -> np.ndarray:
    """Distances of a block's own cells from those of its rim; of cells around it as known."""
    c = t.layers["cost"]
    d = np.full(c.shape, np.inf)
    node = known["node"].to_numpy()
    d[0, (node >> 32) - t.r0 + 1, (node & 0xFFFFFFFF) - t.c0 + 1] = known["dist"].to_numpy()
    return np.where(t.own, _relaxed(np.where(t.own, d, np.inf), _steps(c, t.own & ~np.isnan(c))), d)


def distance_blocks(tiles: DataFrame, rims: DataFrame, wanted: DataFrame, tile: int, by: Sequence[str] = (), fan: int = COST_FAN) -> DataFrame:
    """Blocks of cost and dist of tile * fan cells on a side, as tiled packs them, for those wanted (by, br, bc), from settled_rims."""
    keys, span = [*by, "br", "bc"], tile * fan
    chosen = small(wanted)
    around = with_rims(rims.withColumns({"row": _row("node"), "col": _col("node")}), span).select(*keys, "row", "col", "dist")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left.iloc[:1].drop(columns=["__r", "__c"])
        if not len(left):
            return out
        r0, c0 = int(out["br"].iloc[0]) * span, int(out["bc"].iloc[0]) * span
        a = np.full((3, span + 2, span + 2), np.nan)
        dist = np.full((span + 2, span + 2), np.inf)
        dist[right["row"].to_numpy(np.int64) - r0 + 1, right["col"].to_numpy(np.int64) - c0 + 1] = right["dist"].to_numpy()
        held = [Tiles(r, ["cost"], tile) for r in left.drop(columns=["br", "bc"]).rename(columns={"__r": "br", "__c": "bc"}).itertuples(index=False)]
        for t in held:
            # cells around the block first, which are another block's own
            at = slice(t.r0 - r0, t.r0 - r0 + tile + 2), slice(t.c0 - c0, t.c0 - c0 + tile + 2)
            a[0][at], a[1][at] = np.where(t.here[0], 1.0, a[0][at]), np.where(t.here[0], t.layers["cost"][0], a[1][at])
        for t in held:
            at = slice(t.r0 - r0, t.r0 - r0 + tile + 2), slice(t.c0 - c0, t.c0 - c0 + tile + 2)
            own, c = t.own[0], t.layers["cost"][0]
            free = own & ~np.isnan(c)
            dist[at] = np.where(own, _relaxed(np.where(own, dist[at], np.inf), _steps(c, free)), dist[at])
        a[2] = np.where(a[0] == 1, dist, np.nan)
        out["body"] = [pa.compress(a.tobytes(), codec="zstd", asbytes=True)]
        return out

    own = tiles.select(*by, F.floor(F.col("br") / fan).cast("int").alias("br"), F.floor(F.col("bc") / fan).cast("int").alias("bc"), "h", "w", "body", F.col("br").alias("__r"), F.col("bc").alias("__c"))
    return own.join(chosen, keys, "left_semi").groupBy(*keys).cogroup(around.join(chosen, keys, "left_semi").groupBy(*keys)).applyInPandas(run, f"{_types(tiles, by)}br int, bc int, h int, w int, body binary")
