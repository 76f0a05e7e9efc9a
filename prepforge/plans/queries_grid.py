"""Queries over the point cloud that lineitem stands for, and its grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spatial as sa
from ..operators import terrain as te
from ..operators.durable import durable
from ..operators.ranks import lowest_border, spaced_top
from ..operators.stats import percentiles
from .flows import terrain_hot_spots, terrain_report
from .queries_text import points
from .registry import query

_P = "side as (select greatest(ceil(sqrt(count(*) / 15.0)), 4)::bigint as s from lineitem), p as (select l_orderkey * 10 + l_linenumber as id, (l_partkey % s)::double as x, (l_suppkey % s)::double as y, l_extendedprice::double / 1000 as z, (l_orderkey % 3)::int as village from lineitem, side)"
_I = _P + ", m as (select min(x) as x0, max(y) as y1, max(x) as x1, min(y) as y0, ceil(max(y) - min(y))::int as nr, ceil(max(x) - min(x))::int as nc from p), i as (select id, z, floor(y1 - y)::int as row, floor(x - x0)::int as col from p, m where floor(y1 - y) < ceil(y1 - y0) and floor(x - x0) < ceil(x1 - x0))"


def _indexed(t):
    p = points(t)
    return sa.cell_index(p, sa.grid_meta(p, 1.0))


def _cells(t, stat="mean"):
    """Heights in steps of a thousandth. Prices are summed as whole cents, so that any order gives the same surface."""
    cents = _indexed(t).withColumn("z", F.round(F.col("z") * 100_000))
    return te.rasterise(cents, stat).withColumn("value", F.round(F.col("value") / 100) / 1000)


def _size(t):
    """Rows and columns of the grid."""
    m = sa.grid_meta(points(t), 1.0).first()
    return m.nrows, m.ncols


def _grid(t):
    return durable(te.fill_gaps(_cells(t), *_size(t)).withColumn("value", F.round("value", 3)))


_C = _I + ", c as (select row, col, round(avg(round(z * 100000)) / 100) / 1000 as value from i group by 1, 2)"


@query(f"with {_P} select min(x) as x_min, max(y) as y_max, 1.0::double as res, ceil(max(y) - min(y))::int as nrows, ceil(max(x) - min(x))::int as ncols from p")
def g03_grid_meta(t):
    return sa.grid_meta(points(t), 1.0)


@query(f"with {_I} select id, row, col, row::double as r from i")
def d13_cell_index(t):
    return _indexed(t).select("id", "row", "col", F.col("row").cast("double").alias("r"))


@query(f"with {_C} select row, col, (col + 0.5 + (select x0 from m))::double as x, ((select y1 from m) - (row + 0.5))::double as y from c")
def d14_cell_centres(t):
    p = points(t)
    return sa.cell_centre(_cells(t), sa.grid_meta(p, 1.0)).select("row", "col", "x", "y")


@query(f"with {_I} select row, col, round(avg(z), 10) as mean, round(min(z), 10) as min, round(median(z), 10) as median, round(quantile_cont(z, 0.05), 10) as p05, round(quantile_cont(z, 0.1), 10) as p10 from i group by row, col")
def a11_g04_rasterise(t):
    stats = ("mean", "min", "median", "p05", "p10")
    return te.rasterise_all(_indexed(t), *stats).select("row", "col", *[F.round(c, 10).alias(c) for c in stats])


@query(f"""with {_I}, n as (select count(*) as n from i group by row, col)
select count(*) as cells, round(100 * count(*) / (select nr * nc from m), 6) as coverage_pct, min(n) as min, floor(quantile_cont(n, 0.5))::bigint as p50, floor(quantile_cont(n, 0.9))::bigint as p90, floor(quantile_cont(n, 0.99))::bigint as p99, max(n) as max, floor(quantile_cont(n, 0.5)) <= 1 as sparse from n""")
def a12_points_per_cell(t):
    rows, columns = _size(t)
    return te.points_per_cell(_indexed(t), rows * columns)


@query(f"""with {_C}, g as (select r as row, k as col from (select unnest(range(0, nr)) as r from m), (select unnest(range(0, nc)) as k from m)), d as (select g.row, g.col, value from g left join c on g.row = c.row and g.col = c.col),
e as (select row, col, coalesce(lead(value) over (partition by row order by col) - value, 0) as dx, coalesce(lead(value) over (partition by col order by row) - value, 0) as dy from d)
select round(avg(sqrt(dx * dx + dy * dy)), 6) as roughness from e, m where row < nr - 1 and col < nc - 1""")
def a13_w06_roughness(t):
    return te.roughness(_cells(t), *_size(t))


@query(f"with {_I}, s as (select row, col, median(z) as a, quantile_cont(z, 0.05) as b from i group by 1, 2) select round(100 * avg(cast(a - b > 2 as int)), 6) as leak_pct from s")
def a14_g08_leakage_share(t):
    i = _indexed(t)
    return te.leakage_share(te.rasterise(i, "median"), te.rasterise(i, "p05"))


@query(f"""with {_I}, low as (select row, col, min(z) as z from i group by 1, 2), base as (select a.row, a.col, min(b.z) as z from low a join low b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 group by 1, 2)
select id, case when i.z - base.z <= 5 then 2 else 1 end as label from i join base using (row, col)""")
def g01_ground_labels(t):
    return te.ground_labels(_indexed(t), 5.0).select("id", "label")


@query(f"with {_I}, low as (select row, col, min(z) as z from i group by 1, 2), base as (select a.row, a.col, min(b.z) as z from low a join low b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 group by 1, 2) select round(avg(cast(i.z - base.z <= 5 as double)), 9) as ground_share, count(*) as n from i join base using (row, col)")
def g02_ground_share(t):
    return te.ground_labels(_indexed(t), 5.0).agg(F.round(F.avg((F.col("label") == 2).cast("double")), 9).alias("ground_share"), F.count("*").alias("n"))


@query(f"""with {_C}, f as (select * from c where (row * 7 + col * 3) % 5 <> 0), e as (select row, col from c where (row * 7 + col * 3) % 5 = 0),
n as (select e.row, e.col, f.value, (e.row - f.row) ** 2 + (e.col - f.col) ** 2 as d2, row_number() over (partition by e.row, e.col order by (e.row - f.row) ** 2 + (e.col - f.col) ** 2, f.row, f.col) as r from e join f on abs(e.row - f.row) <= 12 and abs(e.col - f.col) <= 12)
select row, col, round(sum(value / greatest(sqrt(d2), 1e-6) ** 2) / sum(1 / greatest(sqrt(d2), 1e-6) ** 2), 6) as idw, round(max(value) filter (where r = 1), 6) as nearest from n where r <= 8 group by row, col""")
def j09_g05_nearest_filled(t):
    c = durable(_cells(t))
    hole = F.pmod(F.col("row") * 7 + F.col("col") * 3, F.lit(5)) == 0
    near = sa.nearest_filled(c.filter(hole).select("row", "col"), c.filter(~hole), 8)
    w = 1 / F.pow(F.greatest(F.sqrt("d2"), F.lit(1e-6)), F.lit(2.0))
    return near.groupBy("row", "col").agg(F.round(F.sum(w * F.col("n_value")) / F.sum(w), 6).alias("idw"), F.round(F.max(F.when(F.col("place") == 0, F.col("n_value"))), 6).alias("nearest"))


_D8 = "(values (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1), (4, 0, -1), (5, -1, -1), (6, -1, 0), (7, -1, 1)) as s(d, dr, dc)"


@query(f"with {_C} select a.row, a.col, s.d, b.value as n_value from c a, {_D8} join c b on b.row = a.row + s.dr and b.col = a.col + s.dc")
def j10_neighbours(t):
    return sa.neighbours(_cells(t)).select("row", "col", "d", "n_value")


@query(f"""with {_C}, n as (select a.row, a.col, s.d, (a.value - b.value) / sqrt(s.dr ** 2 + s.dc ** 2) as slope from c a, {_D8} join c b on b.row = a.row + s.dr and b.col = a.col + s.dc),
b as (select row, col, d from (select *, row_number() over (partition by row, col order by slope desc, d) as r from n) where r = 1)
select c.row, c.col, cast(case when c.row between 1 and (select max(row) from c) - 1 and c.col between 1 and (select max(col) from c) - 1 then coalesce(b.d, 0) else 0 end as int) as d from c left join b using (row, col)""")
def g10_flow_direction(t):
    return te.flow_direction(_cells(t)).select("row", "col", "d")

_FILLED = f"""edge as (select max(row) as h, max(col) as w from c),
w(row, col, value) using key (row, col) as (select row, col, value from c, edge where row = 0 or col = 0 or row = h or col = edge.w
 union select n.row, n.col, min(greatest(n.value, w.value)) from w, {_D8} join c n on n.row = w.row + s.dr and n.col = w.col + s.dc left join recurring.w o on o.row = n.row and o.col = n.col where o.value is null or greatest(n.value, w.value) < o.value group by n.row, n.col)"""
_FLOW = f"""n as (select a.row, a.col, s.d, (a.value - b.value) / sqrt(s.dr ** 2 + s.dc ** 2) as slope from c a, {_D8} join c b on b.row = a.row + s.dr and b.col = a.col + s.dc),
b as (select row, col, d from (select *, row_number() over (partition by row, col order by slope desc, d) as r from n) where r = 1),
f as (select c.row, c.col, c.value, case when c.row between 1 and (select max(row) from c) - 1 and c.col between 1 and (select max(col) from c) - 1 then coalesce(b.d, 0) else 0 end as d from c left join b using (row, col)),
e as (select f.row, f.col, g.row as tr, g.col as tc, f.value > g.value or (f.value = g.value and (s.dr < 0 or (s.dr = 0 and s.dc < 0))) as early from f join {_D8} on s.d = f.d join c g on g.row = f.row + s.dr and g.col = f.col + s.dc),
way(row, col) as (select row, col from c union all select e.tr, e.tc from way join e using (row, col) where early),
a as (select row, col, count(*) as a from way group by row, col), late as (select tr as row, tc as col, sum(a) as a from e join a using (row, col) where not early group by tr, tc),
acc as (select row, col, (a.a + coalesce(late.a, 0))::double as acc from a left join late using (row, col))"""
_BEST = "first(c.{} order by c.value desc, c.row, c.col)"
_SPACED = f"""k(pick, row, col, value, picks) as (select 0, null::int, null::int, null::double, []::struct(r int, k int)[]
 union all select pick + 1, {_BEST.format('row')}, {_BEST.format('col')}, max(c.value), list_append(any_value(picks), {{'r': {_BEST.format('row')}, 'k': {_BEST.format('col')}}})
 from k, c where pick < 10 and not list_bool_or(list_transform(picks || [{{'r': -1000, 'k': -1000}}], lambda x: sqrt((x.r - c.row) ** 2 + (x.k - c.col) ** 2) <= 12)) group by pick)"""


_BLUR = "g as (select unnest(range(-4, 5))::int as o, exp(-0.5 * unnest(range(-4, 5)) ** 2) / (select sum(exp(-0.5 * x ** 2)) from (select unnest(range(-4, 5)) as x)) as w)"
_MIRROR = "case when {0} < 0 then -{0} - 1 when {0} >= {1} then 2 * {1} - 1 - {0} else {0} end"


@query(f"""with {_I}, c as (select row, col, quantile_cont(z, 0.05) as value from i group by 1, 2), {_BLUR},
a as (select c.row, c.col, sum(b.value * g.w) as value from c, m, g join c b on b.col = c.col and b.row = {_MIRROR.format("(c.row + g.o)", "m.nr")} group by c.row, c.col)
select a.row, a.col, round(sum(b.value * g.w), 6) as value from a, m, g join a b on b.row = a.row and b.col = {_MIRROR.format("(a.col + g.o)", "m.nc")} group by a.row, a.col""")
def g06_g07_dtm(t):
    dtm, _ = te.make_dtm(points(t), 1.0, "p05")
    return dtm.withColumn("value", F.round("value", 6))


@query(f"with recursive {_C}, {_FILLED} select row, col, value from w")
def g09_fill_depressions(t):
    return te.fill_depressions(_grid(t), tile=16)


@query(f"with recursive {_C}, {_FLOW} select row, col, acc from acc")
def g11_flow_accumulation(t):
    return te.flow_accumulation(durable(te.flow_direction(_grid(t))), tile=16)


_SOBEL = "k as (select dr, dc, gx, gy from (values (-1, -1, -1, -1), (-1, 0, 0, -2), (-1, 1, 1, -1), (0, -1, -2, 0), (0, 1, 2, 0), (1, -1, -1, 1), (1, 0, 0, 2), (1, 1, 1, 1)) as k(dr, dc, gx, gy))"


@query(f"""with recursive {_C}, {_FLOW}, {_SOBEL},
h as (select c.row, c.col, greatest(sqrt((sum(x.value * k.gx) / 8) ** 2 + (sum(x.value * k.gy) / 8) ** 2), 0.001) as slope from c, m, k join c x on x.row = {_MIRROR.format("(c.row + k.dr)", "m.nr")} and x.col = {_MIRROR.format("(c.col + k.dc)", "m.nc")} group by c.row, c.col)
select row, col, round(ln(acc / slope), 6) as value, round(slope, 6) as slope from h join acc using (row, col)""")
def g12_g13_slope_and_wetness(t):
    g = _grid(t)
    s = durable(te.slope(g, *_size(t), 1.0, 0.001))
    acc = te.flow_accumulation(durable(te.flow_direction(g)), tile=16)
    return te.wetness(acc, s, 1.0).join(s, ["row", "col"]).select("row", "col", F.round("value", 6).alias("value"), F.round("slope", 6).alias("slope"))


@query()
def g14_g15_l8_hot_spots(t):
    return terrain_hot_spots(points(t), 1.0, tile=16)


@query(f"with {_C}, q as (select quantile_cont(value, 0.1) as q from c) select row, col, value <= q as low from c, q")
def g16_low_lying(t):
    return te.low_lying(_cells(t)).select("row", "col", "low")


@query(f"with {_C} select row, col, value as z from (select *, case when row = 0 then 0 when row = mr then 1 when col = 0 then 2 when col = mc then 3 end as side from c, (select max(row) as mr, max(col) as mc from c)) where side is not null order by value, side, case when side < 2 then col else row end limit 1")
def t05_g18_lowest_border(t):
    return lowest_border(_cells(t))


@query(f"with recursive {_C}, {_SPACED} select pick, row, col, value from k where pick > 0")
def t04_g18_spaced_top(t):
    return spaced_top(_cells(t), "value", 10, 12.0)


@query()
def g17_g20_drainage(t):
    g = _grid(t)
    s = durable(te.slope(g, *_size(t), 1.0))
    acc = durable(te.flow_accumulation(durable(te.flow_direction(g)), tile=16))
    return te.polylines(te.drainage(g, s, acc, 5, 15.0, tile=16), 0.0, float(_size(t)[0]), 1.0)


@query()
def a24_a27_l9_terrain_report(t):
    """Report of the whole point cloud: points, heights, hectares at risk, channels and checks."""
    return terrain_report(points(t), 1.0, tile=16, paths=5, apart=15.0)


@query()
def g21_village_batch(t):
    """Hot spots of three villages that share coordinates, in one run."""
    return terrain_hot_spots(points(t), 1.0, tile=16, by=["village"])


@query()
def g21_l9_village_reports(t):
    """Reports of the three villages."""
    return terrain_report(points(t), 1.0, tile=16, paths=3, apart=15.0, by=["village"])


_V = _P + """, m as (select village, min(x) as x0, max(y) as y1, ceil(max(y) - min(y))::int as nr, ceil(max(x) - min(x))::int as nc from p group by village),
i as (select village, z, floor(y1 - y)::int as row, floor(x - x0)::int as col from p join m using (village) where floor(y1 - y) < nr and floor(x - x0) < nc),
c as (select village, row, col, quantile_cont(z, 0.05) as value from i group by 1, 2, 3)"""


@query(f"with {_V} select village, count(*) as cells, round(100 * count(*) / any_value(nr * nc), 6) as coverage_pct, round(max(value) - min(value), 6) as range, round(stddev_pop(value), 6) as std from c join m using (village) group by village")
def a25_village_heights(t):
    """Coverage, height range and deviation of each village's grid."""
    p = points(t)
    meta = durable(sa.grid_meta(p, 1.0, ["village"]))
    cells = te.rasterise(sa.cell_index(p, meta, ["village"]), "p05", ["village"])
    sizes = meta.select("village", (F.col("nrows").cast("long") * F.col("ncols")).alias("n"))
    rows = cells.groupBy("village").agg(F.count("*").alias("cells"), F.round(F.max("value") - F.min("value"), 6).alias("range"), F.round(F.stddev_pop("value"), 6).alias("std"))
    return rows.join(sizes, "village").select("village", "cells", F.round(100 * F.col("cells") / F.col("n"), 6).alias("coverage_pct"), "range", "std")


@query(f"with {_C} select round(quantile_cont(value, 0.98), 6) as p98 from c where value > 0")
def a23_grid_percentile(t):
    return percentiles(_cells(t), "value", [0.98], F.col("value") > 0)


@query("select s_suppkey, cast(floor((lon + 180) / 6) + 1 as int) as zone, cast(case when lat >= 0 then 32600 else 32700 end + floor((lon + 180) / 6) + 1 as int) as epsg from (select s_suppkey, s_suppkey * 37 % 360 - 180.0 as lon, s_suppkey * 17 % 160 - 80.0 as lat from supplier)")
def d11_utm_zone(t):
    s = t("supplier").select("s_suppkey", (F.col("s_suppkey") * 37 % 360 - 180.0).alias("lon"), (F.col("s_suppkey") * 17 % 160 - 80.0).alias("lat"))
    zone, epsg = sa.utm_zone("lon", "lat")
    return s.select("s_suppkey", zone.alias("zone"), epsg.alias("epsg"))


@query(f"""with {_P}, k as (select 6378137.0::double as a, (1 / 298.257223563::double) / (2 - 1 / 298.257223563::double) as n),
c as (select *, a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) as radius, [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16, 13 * n ** 2 / 48 - 3 * n ** 3 / 5, 61 * n ** 3 / 240] as alpha, 2 * sqrt(n) / (1 + n) as e from k),
r as (select id, radians(12 + y / 64) as phi, radians(77 + x / 64 - (43 * 6 - 183)) as lam, c.* from p, c),
t as (select *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) as t from r), u as (select *, atan2(t, cos(lam)) as xi, atanh(sin(lam) / sqrt(1 + t * t)) as eta from t)
select id, round(500000 + 0.9996 * radius * (eta + list_sum(list_transform(range(1, 4), lambda j: alpha[j] * cos(2 * j * xi) * sinh(2 * j * eta)))), 3) as x,
  round(0.9996 * radius * (xi + list_sum(list_transform(range(1, 4), lambda j: alpha[j] * sin(2 * j * xi) * cosh(2 * j * eta)))), 3) as y from u""")
def d12_to_utm(t):
    p = points(t).select("id", (77 + F.col("x") / 64).alias("x"), (12 + F.col("y") / 64).alias("y"))
    return sa.to_utm(p, 43).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("select l_orderkey, l_linenumber, l_quantity / 255.0::double as l_quantity from lineitem")
def d15_scaled_colours(t):
    return sa.scaled_colours(t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("l_quantity")), "l_quantity")


@query("select n_name as village, r.rule as rule, coalesce(case r.rule when 'coverage' then n_nationkey > 15 when 'range' then n_regionkey * 10 > 10 when 'std' then n_regionkey > 1.0 else n_nationkey between 5 and 15 end, false) as pass from nation, (select unnest(['coverage', 'range', 'std', 'paths']) as rule) r")
def g22_village_checks(t):
    m = t("nation").select(F.col("n_name").alias("village"), F.col("n_nationkey").alias("coverage_pct"), (F.col("n_regionkey") * 10).alias("range"), F.col("n_regionkey").alias("std"), F.col("n_nationkey").alias("paths"))
    return te.village_checks(m)


@query(f"""with {_I}, s as (select count(*) as n, stddev_pop(z) as d from i), g as (select count(*) as n, stddev_pop(i.z) as d from i join (select a.row, a.col, min(b.z) as z from (select row, col, min(z) as z from i group by 1, 2) a join (select row, col, min(z) as z from i group by 1, 2) b on abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1 group by 1, 2) base using (row, col) where i.z - base.z <= 5)
select m.metric, m.baseline, m.refined, round(m.refined / m.baseline, 6) as factor, round((m.refined - m.baseline) / m.baseline * 100, 6) as pct from
(select 'points' as metric, s.n::double as baseline, g.n::double as refined from s, g union all select 'std', round(s.d, 9), round(g.d, 9) from s, g) m""")
def g23_a26_method_comparison(t):
    i = te.ground_labels(_indexed(t), 5.0)
    stats = lambda df, name: df.agg(F.count("*").cast("double").alias("points"), F.round(F.stddev_pop("z"), 9).alias("std")).unpivot([], ["points", "std"], "metric", "value").withColumn("method", F.lit(name))
    return te.method_comparison(stats(i, "baseline").unionByName(stats(i.filter("label = 2"), "refined")), "baseline", "refined")


@query(f"with {_C} select row, col, case when value - 30 >= -1000 and (row + col) % 9 <> 0 then value - 30 end as value from c")
def s12_mask_nodata(t):
    from ..sources.io import NODATA, mask_nodata

    raw = _cells(t).withColumn("value", F.when(F.pmod(F.col("row") + F.col("col"), F.lit(9)) == 0, NODATA).otherwise(F.col("value") - 30))
    return mask_nodata(raw)


@query("select o_custkey as path, count(*) as points, min(o_orderkey)::double as x_min from orders group by o_custkey")
def s13_geojson_lines(t):
    """Each customer's orders as a line, written as GeoJSON features and read back."""
    from ..sources.io import from_geojson, to_geojson

    p = F.struct(F.col("o_orderkey").cast("double").alias("x"), F.col("o_totalprice").cast("double").alias("y"))
    lines = t("orders").groupBy(F.col("o_custkey").alias("path")).agg(F.array_sort(F.collect_list(p)).alias("points"))
    back = from_geojson(to_geojson(lines, "points", "path"), "path long")
    return back.select("path", F.size("points").cast("long").alias("points"), F.array_min(F.transform("points", lambda q: q.x)).alias("x_min"))
