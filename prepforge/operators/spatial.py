"""Points and cells: UTM projection, cell indices, neighbour joins, k nearest filled cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable

#: Eight neighbours in the order of flow codes: E, SE, S, SW, W, NW, N, NE.
NEIGHBOURS = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def utm_zone(lon: str | Column, lat: str | Column) -> tuple[Column, Column]:
    """Zone and EPSG code (326zz north, 327zz south)."""
    lon, lat = (F.col(c) if isinstance(c, str) else c for c in (lon, lat))
    zone = (F.floor((lon + 180) / 6) + 1).cast("int")
    return zone, (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def to_utm(points: DataFrame, zone: int, north: bool = True, lon: str = "x", lat: str = "y") -> DataFrame:
    """x and y in metres of a UTM zone, by the transverse Mercator series in the third flattening (WGS 84)."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(F.col(lat)), F.radians(F.col(lon) - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + sum((k * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, k in enumerate(alpha, 1)), F.lit(0.0))
    north_ = xi + sum((k * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, k in enumerate(alpha, 1)), F.lit(0.0))
    k0 = 0.9996
    return points.withColumns({lon: 500000.0 + k0 * radius * east, lat: (0.0 if north else 10_000_000.0) + k0 * radius * north_})


def grid_meta(points: DataFrame, res: float, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each of by: x_min, y_max, res, nrows, ncols."""
    box = points.groupBy(*by).agg(F.min("x").cast("double").alias("x_min"), F.max("y").cast("double").alias("y_max"), F.max("x").cast("double").alias("x_max"), F.min("y").cast("double").alias("y_min"))
    cells = lambda a, b: F.ceil((F.col(a) - F.col(b)) / res).cast("int")
    return box.select(*by, "x_min", "y_max", F.lit(float(res)).alias("res"), cells("y_max", "y_min").alias("nrows"), cells("x_max", "x_min").alias("ncols"))


def _with_meta(df: DataFrame, meta: DataFrame, by: Sequence[str]) -> DataFrame:
    from .joins import small

    return df.join(small(meta), list(by)) if by else df.crossJoin(F.broadcast(meta))  # one row for each grid


def cell_index(points: DataFrame, meta: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """row and col of each point in its grid; points outside the grid, which the far edges are, are dropped."""
    p = _with_meta(points, meta, by)
    p = p.withColumns({"row": F.floor((F.col("y_max") - F.col("y")) / F.col("res")).cast("int"), "col": F.floor((F.col("x") - F.col("x_min")) / F.col("res")).cast("int")})
    return p.filter("row >= 0 and row < nrows and col >= 0 and col < ncols").drop(*[c for c in meta.columns if c not in by])


def cell_centre(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """x and y of each cell's centre."""
    c = cells.crossJoin(F.broadcast(meta))  # one row on the right
    return c.withColumns({"x": F.col("x_min") + (F.col("col") + 0.5) * F.col("res"), "y": F.col("y_max") - (F.col("row") + 0.5) * F.col("res")}).drop(*meta.columns)


def scaled_colours(points: DataFrame, *bands: str) -> DataFrame:
    """Bands from 0 to 1: divided by 65535 if any value is beyond 255, else by 255."""
    top = points.agg(F.greatest(*[F.coalesce(F.max(b), F.lit(0)) for b in bands], F.lit(0)).alias("__top"))
    scale = F.when(F.col("__top") > 255, 65535.0).otherwise(255.0)
    return points.crossJoin(F.broadcast(top)).withColumns({b: F.col(b) / scale for b in bands}).drop("__top")  # one row on the right


def neighbours(cells: DataFrame, value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """row, col, its value, and for each existing neighbour d (flow code), n_row, n_col, n_value, dist."""
    steps = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for d, (dr, dc) in enumerate(NEIGHBOURS)])
    a = cells.select(*by, "row", "col", value, F.explode(steps).alias("s")).select(*by, "row", "col", value, "s.d", (F.col("row") + F.col("s.dr")).alias("n_row"), (F.col("col") + F.col("s.dc")).alias("n_col"), F.hypot(F.col("s.dr").cast("double"), F.col("s.dc").cast("double")).alias("dist"))
    b = cells.select(*by, F.col("row").alias("n_row"), F.col("col").alias("n_col"), F.col(value).alias("n_value"))
    return a.join(b, [*by, "n_row", "n_col"])


def nearest_filled(empty: DataFrame, filled: DataFrame, k: int, value: str = "value", block: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """The k nearest filled cells (row, col, n_value, d2, place) of each empty cell, ties to the smaller row, then column.

    Empty cells ask as blocks of block x block cells. A pyramid of the numbers of filled cells is gone down level by level: of its squares, a
    block keeps those that are not beyond the distance within which the squares' numbers warrant k cells. The cells of the squares that
    are left are sent to the block, which ranks them. So a block looks as far as it has to, in as many rounds as the pyramid has levels, and no
    task holds more than what a few neighbouring blocks need.
    """
    kinds = dict(empty.dtypes)
    names = "".join(f"`{c}` {kinds[c]}, " for c in by)
    place = lambda c: F.floor(F.col(c) / block).cast("int")
    cells = filled.select(*by, F.col("row").cast("int").alias("fr"), F.col("col").cast("int").alias("fc"), F.col(value).cast("double").alias("n_value")).withColumns({"r": place("fr"), "c": place("fc")})
    asked = durable(empty.select(*by, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).withColumns({"br": place("row"), "bc": place("col")}))
    levels = [durable(cells.groupBy(*by, "r", "c").agg(F.count("*").alias("n")))]
    while (most := levels[-1].agg(F.max(F.greatest("r", "c")).alias("m")).first().m) is not None and most > 0:
        levels.append(durable(levels[-1].groupBy(*by, F.shiftright("r", 1).alias("r"), F.shiftright("c", 1).alias("c")).agg(F.sum("n").alias("n"))))
    own = [*by, "br", "bc"]
    found = asked.select(*own).distinct()
    top = levels[-1].select(*by, "r", "c", "n")
    found = found.join(F.broadcast(top), list(by)) if by else found.crossJoin(F.broadcast(top))  # one square for each grid
    for level in range(len(levels) - 1, -1, -1):
        side = block << level
        if level < len(levels) - 1:
            two = F.array(F.lit(0), F.lit(1))
            parts = found.select(*own, (2 * F.col("r")).alias("r2"), (2 * F.col("c")).alias("c2")).withColumn("dr", F.explode(two)).withColumn("dc", F.explode(two))
            found = parts.select(*own, (F.col("r2") + F.col("dr")).alias("r"), (F.col("c2") + F.col("dc")).alias("c")).join(levels[level], [*by, "r", "c"])
        gap = lambda a, b: F.greatest(F.lit(0), F.col(a) * side - (F.col(b) * block + block - 1), F.col(b) * block - (F.col(a) * side + side - 1)).cast("long")  # noqa: B023, E731
        span = lambda a, b: F.greatest(F.col(a) * side + side - 1 - F.col(b) * block, F.col(b) * block + block - 1 - F.col(a) * side).cast("long")  # noqa: B023, E731
        far = found.withColumns({"near": gap("r", "br") * gap("r", "br") + gap("c", "bc") * gap("c", "bc"), "far": span("r", "br") * span("r", "br") + span("c", "bc") * span("c", "bc")})
        within = far.withColumn("upto", F.sum("n").over(Window.partitionBy(*own).orderBy("far").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        limit = F.min(F.when(F.col("upto") >= k, F.col("far"))).over(Window.partitionBy(*own))
        found = durable(within.withColumn("limit", limit).filter("limit is null or near <= limit").select(*own, "r", "c"))
    sent = found.join(cells, [*by, "r", "c"]).select(*[F.col(c).alias(c) for c in by], F.col("br").alias("qr"), F.col("bc").alias("qc"), "fr", "fc", "n_value")
    columns = [*by, "row", "col", "n_value", "d2", "place"]

    def ranked(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        # both sides in order once: asked cells by block, sent ones by block, row and column
        ask = {c: left[c].to_numpy(np.int64) for c in ("br", "bc", "row", "col")}
        got = {c: right[c].to_numpy(np.int64) for c in ("qr", "qc", "fr", "fc")}
        name = lambda a, b: a << 32 | b
        to, of = np.argsort(name(ask["br"], ask["bc"]), kind="stable"), np.lexsort((got["fc"], got["fr"], name(got["qr"], got["qc"])))
        row, col, block_ = ask["row"][to], ask["col"][to], name(ask["br"], ask["bc"])[to]
        fr, fc, sent_to, value_ = got["fr"][of], got["fc"][of], name(got["qr"], got["qc"])[of], right["n_value"].to_numpy(float)[of]
        parts = {c: [] for c in columns[len(by) :]}
        for b in np.unique(block_):
            (i, j), (lo, hi) = (np.searchsorted(x, (b, b + 1)) for x in (block_, sent_to))
            if lo == hi:
                continue
            n_sent = hi - lo
            d2 = (row[i:j, None] - fr[lo:hi]) ** 2 + (col[i:j, None] - fc[lo:hi]) ** 2
            # cells are in order of row and column, so their number settles ties
            order = d2 * n_sent + np.arange(n_sent)
            best = np.sort(np.partition(order, k - 1, axis=1)[:, :k], axis=1) if n_sent > k else np.sort(order, axis=1)
            n = best.shape[1]
            for c, x in zip(parts, (np.repeat(row[i:j], n), np.repeat(col[i:j], n), value_[lo:hi][best % n_sent].ravel(), (best // n_sent).ravel().astype(float), np.tile(np.arange(n), j - i)), strict=True):
                parts[c].append(x)
        if not parts["row"]:
            return pd.DataFrame(columns=columns)
        whole = pd.DataFrame({c: np.concatenate(x) for c, x in parts.items()})
        for x in by:
            whole[x] = left[x].iloc[0]
        return whole

    group = lambda r, c: [*by, F.shiftright(r, 2).alias("gr"), F.shiftright(c, 2).alias("gc")]
    return asked.groupBy(*group("br", "bc")).cogroup(sent.groupBy(*group("qr", "qc"))).applyInPandas(ranked, f"{names}row int, col int, n_value double, d2 double, place int")
