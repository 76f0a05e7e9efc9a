"""Golden rows, properties, and sequential versions of the grid algorithms."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepforge.functions import metrics as mt
from prepforge.functions import text as tx
from prepforge.functions.slots import same_slot, weekly_slot
from prepforge.operators import columns as co
from prepforge.operators import encode as en
from prepforge.operators import ensemble as es
from prepforge.operators import joins as jo
from prepforge.operators import models as mo
from prepforge.operators import ranks as ra
from prepforge.operators import rims
from prepforge.operators import spatial as sa
from prepforge.operators import splits as sp
from prepforge.operators import terrain as te
from prepforge.sources import io
from prepforge.streaming.slots import slot_counts


def one(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_packs(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["6x250ml", "500g", "12 count", "3 units", None, "2 x 1.5 fl. oz bottle", "nothing"])], "i int, s string")
    got = {r.i: tuple(r.p) for r in df.select("i", tx.parse_pack("s").alias("p")).collect()}
    assert got == {0: (250.0, "ml", 6), 1: (500.0, "g", None), 2: (12.0, "count", None), 3: (None, "count", 3), 4: (None, None, None), 5: (1.5, "fl oz", 2), 6: (None, None, None)}
    clean = {r.i: (r.item_pack_clean, r.has_pack) for r in tx.clean_pack(df.withColumnRenamed("s", "item_pack")).collect()}
    assert clean[0] == ("6x250 ml", 1) and clean[1] == ("500 g", 1) and clean[3] == ("3 count", 1) and clean[4] == (None, 0)


def test_units(spark):
    df = spark.createDataFrame([("Fl. Oz",), ("oz.",), ("Litres",), ("smoots",)], "u string")
    assert one(df.select(tx.unit_name(F.col("u")).alias("u")), "u") == [("fl oz",), ("oz",), ("l",), ("smoots",)]
    assert one(df.select(tx.unit_name(F.col("u"), strict=True).alias("u")), "u") == [("fl oz",), ("oz ",), ("l",), ("smoots",)]


def test_catalog_fields(spark):
    texts = ["Item Name: Good Tea\nProduct Description: x\nDescription: Green leaves\nValue: 5", "\r\nPlain name\n- one\n* two\n- one\n", "Brand soap. Nice smell. Soft.\nSize: 5 oz", None, ""]
    df = tx.parse_catalog(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, catalog_content string"))
    got = {r.i: (r.item_name, r.item_description, r.item_pack) for r in df.collect()}
    assert got[0][:2] == ("Good Tea", "Green leaves")
    assert got[1] == ("Plain name", "one two", None)
    assert got[2][0] == "Brand soap. Nice smell. Soft." and got[2][2] == "5 oz"
    assert got[3] == got[4] == (None, None, None)


def test_numbers_and_plain_numbers(spark):
    df = spark.createDataFrame([("2 kg and 4.0cm",), ("",), (None,)], "t string")
    c = tx.numbers("t")
    assert one(df.select(*[v.alias(k) for k, v in c.items()]), "n_numbers", "num_mean", "num_std", "num_max") == [(2, 3.0, 1.0, 4.0), (0, 0.0, 0.0, 0.0), (0, 0.0, 0.0, 0.0)]
    v = spark.createDataFrame([(250.0,), (0.5,), (1234567.0,), (1.23456789,)], "v double").select(tx.plain_number(F.col("v")).alias("v"))
    assert [r.v for r in v.collect()] == ["250", "0.5", "1.23457e+06", "1.23457"]


def test_slots(spark):
    times = ["2024-01-01 09:00:00", "2024-01-01 20:59:00", "2024-01-07 18:00:00", "2024-01-01 08:59:00", "2024-01-01 21:00:00", None]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(weekly_slot(F.col("t").cast("timestamp_ntz")).alias("s"))
    assert [r.s for r in df.collect()] == [1, 4, 28, None, None, None]
    p = spark.createDataFrame([(3, 3), (3, 4), (None, None)], "a int, b int").select(same_slot("a", "b").alias("s"))
    assert [r.s for r in p.collect()] == [1, 0, 0]


def test_asof_edges(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 4), (3, "b", 9), (4, "a", None), (5, None, 10), (6, "a", 11)], "i int, k string, t int")
    right = spark.createDataFrame([("a", 5, "five", 1), ("a", 10, "ten", 1), ("a", 10, "ten again", 2), ("a", 12, "late", 1), (None, 1, "x", 1), ("a", None, "y", 1)], "k string, at int, v string, i int")
    got = {r.i: (r["at"], r.v) for r in jo.asof(left, right, "k", "t", "at", ["v"], tie="i").collect()}
    assert got == {1: (10, "ten again"), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None), 6: (10, "ten again")}


def test_asof_of_a_hot_key(spark):
    """One key holds nine tenths of the rows: its ranges of time are joined apart, and all rows are those of the plain join."""
    left = spark.range(6000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 50).otherwise(7).alias("k"), (F.col("id") * 7919 % 5000).alias("t"), F.col("id").alias("i"))
    left = left.unionByName(left.limit(3).withColumn("t", F.lit(None).cast("long"))).unionByName(left.limit(3).withColumn("k", F.lit(None).cast("long")))
    right = spark.range(900).select(F.when(F.col("id") % 9 == 0, F.col("id") % 50).otherwise(7).alias("k"), (F.col("id") * 31 % 1300 * 3 + 40).alias("at"), F.col("id").alias("v"))
    names = ("i", "k", "t", "at", "v")
    plain = sorted(one(jo.asof(left, right, "k", "t", "at", ["v"], tie="v"), *names), key=str)
    cut = jo.asof(left, right, "k", "t", "at", ["v"], tie="v", share_rows=500)
    assert sorted(one(cut, *names), key=str) == plain and len(plain) == 6006
    assert jo._hot_keys(left.withColumn("__k", F.col("k")), 500).count() == 1
    rows = left.filter("k = 7").select(F.col("k").alias("__k"), F.col("t").alias("__t"))
    sizes = [r["count"] for r in rows.repartitionByRange(4, "__k", "__t").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)
    # times of which all right rows come first
    early = spark.createDataFrame([(7, 0, 1)], "k long, at long, v long")
    assert {r.v for r in jo.asof(left.filter("k = 7 and t is not null"), early, "k", "t", "at", ["v"], share_rows=10).collect()} == {1}


def test_exact_percentiles(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g in (None, 1, 2) for v in rng.integers(0, 40, 300)] + [(3, 5.0), (4, None), (1, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(7)
    cuts = {"low": 0.0, "p05": 0.05, "mid": 0.5, "p98": 0.98, "top": 1.0}
    want = {g: tuple(np.percentile([v for h, v in rows if h == g and v is not None], [100 * q for q in cuts.values()])) for g in (None, 1, 2, 3)}
    got = {r.g: tuple(r)[1:] for r in ra.exact_percentiles(df, "v", cuts, ["g"]).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in got)
    every = ra.exact_percentiles(df, "v", cuts).collect()
    assert len(every) == 1 and tuple(every[0]) == pytest.approx(tuple(np.percentile([v for _, v in rows if v is not None], [100 * q for q in cuts.values()])))
    assert [tuple(r) for r in ra.exact_percentiles(df.limit(0), "v", cuts).collect()] == [(None,) * 5]


def test_spaced_top_of_many_grids(spark):
    rng = np.random.default_rng(5)
    grids = {g: rng.integers(0, 30, (17, 23)).astype(float) for g in (1, 2)}
    df = spark.createDataFrame([(g, r, c, float(a[r, c])) for g, a in grids.items() for r in range(17) for c in range(23)], "g int, row int, col int, value double").repartition(5)
    got = {}
    for r in ra.spaced_top(df, "value", 6, 4.5, by=["g"]).collect():
        got.setdefault(r.g, []).append((r.pick, r.row, r.col))
    for g, a in grids.items():
        picks = []
        for v, r, c in sorted((-a[r, c], r, c) for r in range(17) for c in range(23)):
            if len(picks) < 6 and all(math.hypot(r - y, c - x) > 4.5 for _, y, x in picks):
                picks.append((len(picks) + 1, r, c))
        assert sorted(got[g]) == picks


def test_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 3.0, None)], "A int, b double, c string")
    assert co.lower_names(df).columns == ["a", "b", "c"]
    out = one(co.impute(df, {"b": "numeric", "c": "categorical", "zz": "text"}), "b", "b_is_missing", "c", "c_is_missing")
    assert out == [(-1.0, 1, "x", 0), (3.0, 0, "unknown", 1)]
    assert co.sparse_columns(spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "x int, y int")) == ["x"]
    assert one(df.select(co.ratio("A", "b").alias("r"), co.clip("b", 0, 2).alias("c")), "r", "c")[0] == (None, None)


def test_ranks_and_metrics(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "x int")
    got = sorted((r.x or 99, r.r) for r in ra.percent_rank_average(df, "x", "r").collect())
    # the null counts in the number of rows
    assert [g[1] for g in got] == [1 / 4, 2.5 / 4, 2.5 / 4, None]
    s = spark.createDataFrame([(0.0, 0.0), (1.0, 3.0)], "y double, p double").agg(mt.smape("y", "p").alias("z"), mt.smape("y", "p", "skip").alias("s"))
    assert one(s, "z", "s") == [(50.0, 100.0)]
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 2, 300), rng.integers(0, 20, 300) / 20
    t = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "y int, p double")
    wins = sum((a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]) / (y.sum() * (1 - y).sum())
    assert mt.auc(t, "y", "p").first().auc == pytest.approx(wins, abs=1e-8)
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    assert BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="p", numBins=0).evaluate(t) == pytest.approx(wins, abs=1e-8)
    best = ra.rank_slots(spark.createDataFrame([(1, 3, 0.5), (1, 2, 0.5), (1, 3, 0.9), (1, 1, 0.1)], "k int, slot int, p double"), "k", "slot", "p").first()
    assert best.slots == ["slot_3", "slot_2", "slot_1"]


def test_splits(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7 == 0).cast("int").alias("y"), (F.col("id") % 37).alias("g"))
    f = sp.stratified_k_fold(df, "id", "y", 5).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        n = [r["count"] for r in f if r.y == y]
        assert len(n) == 5 and max(n) - min(n) <= 1
    g = sp.group_k_fold(df, "g", 4)
    assert g.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    sizes = [r["count"] for r in g.groupBy("fold").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) < 60
    h = sp.holdout(df, "id", "y", 0.2).groupBy("y").agg(F.avg((F.col("split") == "val").cast("int")).alias("v")).collect()
    assert all(abs(r.v - 0.2) < 0.01 for r in h)


def test_encoders(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",)], "c string")
    e = en.FrequencyEncoder(train, "c")
    got = one(e.transform(spark.createDataFrame([("a",), ("z",), (None,)], "c string"), "f").orderBy("f", F.col("c").asc_nulls_first()), "c", "f")
    assert got == [(None, 1), ("z", 1), ("a", 2)]
    s = en.Scaler(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, k double"), ["x", "k"])
    assert one(s.transform(spark.createDataFrame([(3.0, 6.0), (None, None)], "x double, k double")), "x", "k") == [(1.0, 1.0), (None, None)]


def test_blends(spark):
    assert all(abs(sum(w) - 1) < 1e-9 for w in es.weight_grid() + es.simplex_grid(10)) and len(es.simplex_grid(100)) == 5151 and len(es.weight_grid()) == 15
    df = spark.createDataFrame([(2.0, 1.0, 3.0), (4.0, 3.0, 5.0)], "y double, a double, b double")
    best = es.best(es.search_weights(df, ["a", "b"], "y", [(w / 10, 1 - w / 10) for w in range(11)], log=False), "smape").first()
    assert best.w_a == 0.5 and best.smape == pytest.approx(0, abs=1e-9)


def cells(spark, a):
    return spark.createDataFrame([(int(r), int(c), None if math.isnan(a[r, c]) else float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])], "row int, col int, value double")


def dense(df, shape, name="value"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[name] is not None:
            out[r["row"], r["col"]] = r[name]
    return out


D8 = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


@pytest.fixture(scope="module")
def surface():
    a = np.random.default_rng(11).integers(0, 12, (14, 15)).astype(float)
    a[5, 6] = a[9, 3] = np.nan
    return a


def flooded(z):
    """Priority flood: cells are settled from the lowest border cell inwards."""
    h, w = z.shape
    out, done = z.copy(), np.isnan(z)
    heap = [(z[r, c], r, c) for r in range(h) for c in range(w) if (r in (0, h - 1) or c in (0, w - 1)) and not done[r, c]]
    for _, r, c in heap:
        done[r, c] = True
    heapq.heapify(heap)
    while heap:
        level, r, c = heapq.heappop(heap)
        for dr, dc in D8:
            y, x = r + dr, c + dc
            if 0 <= y < h and 0 <= x < w and not done[y, x]:
                done[y, x] = True
                out[y, x] = max(z[y, x], level)
                heapq.heappush(heap, (out[y, x], y, x))
    return out


def test_depressions(spark, surface):
    pit = np.full((3, 3), 5.0)
    pit[1, 1] = 1
    assert dense(te.fill_depressions(cells(spark, pit)), (3, 3))[1, 1] == 5
    got = dense(te.fill_depressions(cells(spark, surface), tile=5), surface.shape)
    assert np.array_equal(got, flooded(surface), equal_nan=True)


def test_flow(spark, surface):
    h, w = surface.shape
    d = np.zeros((h, w), int)
    for r in range(1, h - 1):
        for c in range(1, w - 1):
            if not np.isnan(surface[r, c]):
                drops = [((surface[r, c] - surface[r + y, c + x]) / math.hypot(y, x), -k) for k, (y, x) in enumerate(D8) if not np.isnan(surface[r + y, c + x])]
                d[r, c] = -max(drops)[1]
    directed = te.flow_direction(cells(spark, surface))
    assert np.array_equal(dense(directed, surface.shape, "d"), d)
    acc = np.ones((h, w))
    for z, r, c in sorted(((surface[r, c], r, c) for r in range(h) for c in range(w) if not np.isnan(surface[r, c])), reverse=True):
        y, x = r + D8[d[r, c]][0], c + D8[d[r, c]][1]
        if 0 <= y < h and 0 <= x < w:
            acc[y, x] += acc[r, c]
    for tile in (4, 64):
        assert np.array_equal(dense(te.flow_accumulation(directed, tile), surface.shape, "acc"), acc)


def test_routes(spark):
    cost = np.random.default_rng(2).random((9, 11))
    outlet = spark.createDataFrame([(8, 0)], "row int, col int")
    df = te.least_cost(cells(spark, cost).withColumnRenamed("value", "cost"), outlet, tile=4)
    best = np.full(cost.shape, np.inf)
    best[8, 0] = 0
    heap = [(0.0, 8, 0)]
    while heap:
        s, r, c = heapq.heappop(heap)
        for dr, dc in D8:
            y, x = r + dr, c + dc
            if 0 <= y < 9 and 0 <= x < 11:
                t = s + (cost[r, c] + cost[y, x]) / 2 * math.hypot(dr, dc)
                if t < best[y, x] - 1e-15:
                    best[y, x] = t
                    heapq.heappush(heap, (t, y, x))
    assert np.allclose(dense(df, cost.shape, "dist"), best)
    starts = spark.createDataFrame([(1, 0, 10), (2, 3, 3)], "path int, row int, col int")
    paths = te.trace(cells(spark, cost).withColumnRenamed("value", "cost"), df, starts, tile=4)
    for p, r, c in ((1, 0, 10), (2, 3, 3)):
        at = [(x.row, x.col) for x in sorted(paths.filter(F.col("path") == p).collect(), key=lambda x: x.step)]
        assert at[0] == (r, c) and at[-1] == (8, 0)
        total = sum((cost[a] + cost[b]) / 2 * math.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(at[:-1], at[1:], strict=True))
        assert total == pytest.approx(best[r, c])


def test_local_grid_operators(spark):
    a = np.random.default_rng(4).random((6, 8))
    w = np.array([math.exp(-0.5 * i * i) for i in range(-4, 5)])
    w /= w.sum()
    pad = np.pad(a, 4, mode="symmetric")
    want = np.array([[sum(w[i] * w[j] * pad[r + i, c + j] for i in range(9) for j in range(9)) for c in range(8)] for r in range(6)])
    assert np.allclose(dense(te.gaussian(cells(spark, a), 6, 8, 1.0), a.shape), want)
    p = np.pad(a, 1, mode="symmetric")
    sx = sum(k * (p[1 + d : 7 + d, 2:] - p[1 + d : 7 + d, :-2]) for d, k in ((-1, 1), (0, 2), (1, 1)))
    sy = sum(k * (p[2:, 1 + d : 9 + d] - p[:-2, 1 + d : 9 + d]) for d, k in ((-1, 1), (0, 2), (1, 1)))
    assert np.allclose(dense(te.slope(cells(spark, a), 6, 8, 0.5), a.shape, "slope"), np.hypot(sx / 4, sy / 4))
    hole = a.copy()
    hole[2, 2] = hole[5, 7] = np.nan
    filled = dense(te.fill_gaps(cells(spark, hole), 6, 8, "nearest"), a.shape)
    assert not np.isnan(filled).any() and filled[2, 2] in (a[1, 2], a[2, 1], a[2, 3], a[3, 2])


def test_nearest_filled_from_far_and_near(spark):
    """One filled corner, a line, and single cells, in grids of different sizes at once: all distances are those of a full search."""
    rng = np.random.default_rng(12)
    grids, rows = {}, []
    for g, (h, w) in {"corner": (50, 70), "line": (33, 20), "few": (40, 40), "dense": (30, 45), "none": (9, 9)}.items():
        full = np.zeros((h, w), bool)
        if g == "corner":
            full[:3, :4] = True
        elif g == "line":
            full[:, 11] = True
        elif g == "few":
            full[[1, 39, 17], [38, 2, 20]] = True
        elif g == "dense":
            full = rng.random((h, w)) < 0.7
        grids[g] = full
        rows += [(g, r, c, float(100 * r + c) if full[r, c] else None) for r in range(h) for c in range(w)]
    df = spark.createDataFrame(rows, "g string, row int, col int, value double").repartition(5)
    near = sa.nearest_filled(df.filter("value is null").select("g", "row", "col"), df.filter("value is not null"), 5, by=["g"]).collect()
    got = {}
    for r in near:
        got.setdefault((r.g, r.row, r.col), []).append((r.place, r.d2, r.n_value))
    want = {}
    for g, full in grids.items():
        at = np.argwhere(full)
        for r, c in np.argwhere(~full):
            order = sorted(((r - y) ** 2 + (c - x) ** 2, y, x) for y, x in at)[:5]
            if order:
                want[g, r, c] = [(i, float(d), float(100 * y + x)) for i, (d, y, x) in enumerate(order)]
    assert {k: sorted(v) for k, v in got.items()} == want


def test_utm(spark):
    # a point on the central meridian keeps the false easting; one degree east of it at the equator lies 111 km further
    p = spark.createDataFrame([(75.0, 0.0), (76.0, 0.0)], "x double, y double")
    got = one(sa.to_utm(p, 43), "x", "y")
    assert got[0] == pytest.approx((500000, 0), abs=1e-6)
    assert got[1][0] == pytest.approx(611_280.6, abs=1)
    zone, epsg = sa.utm_zone("x", "y")
    assert one(p.limit(1).select(zone.alias("z"), epsg.alias("e")), "z", "e") == [(43, 32643)]


def test_sources(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("id,name\n1,caf\xe9\n".encode("latin-1"))
    assert one(io.read_csv_any_encoding(spark, str(tmp_path / "latin.csv"), "id int, name string"), "name") == [("café",)]
    io.write_metadata(spark, {"folds": 5, "score": 0.8}, str(tmp_path / "meta"))
    assert io.read_metadata(spark, str(tmp_path / "meta")) == {"folds": "5", "score": "0.8"}
    assert io.first_existing(spark, [str(tmp_path / "none"), str(tmp_path / "latin.csv")]) == str(tmp_path / "latin.csv")
    (tmp_path / "big.csv").write_text("x" * 100)
    assert io.smallest_file(spark, str(tmp_path), "*.csv").endswith("latin.csv")
    c = spark.createDataFrame([(0, 0, 1.5), (0, 1, None)], "row int, col int, value double")
    io.write_raster(c, spark.createDataFrame([(0.0, 1)], "x_min double, nrows int"), str(tmp_path / "r"))
    back, meta = io.read_raster(spark, str(tmp_path / "r"))
    assert sorted(one(back, "col", "value")) == [(0, 1.5), (1, None)] and meta.count() == 1
    lines = spark.createDataFrame([(1, [(0.0, 1.0), (2.0, 3.0)])], "path int, points array<struct<x double, y double>>")
    again = io.from_geojson(io.to_geojson(lines, "points", "path"), "path int").first()
    assert again.path == 1 and [tuple(p) for p in again.points] == [(0.0, 1.0), (2.0, 3.0)]
    io.write_csv(spark.range(3), str(tmp_path / "c"))
    io.write_csv(spark.range(3), str(tmp_path / "c"), "append")
    assert io.read_csv(spark, str(tmp_path / "c"), "id long").count() == 6


def test_models(spark, tmp_path):
    df = spark.range(400).select("id", (F.col("id") % 10).cast("double").alias("x"), F.pmod(F.xxhash64("id"), F.lit(7)).cast("double").alias("z")).withColumn("label", (F.col("x") > 4).cast("int"))
    data = sp.k_fold(mo.assemble(df, ["x", "z"]), "id", 2)
    oof, models, tests = mo.out_of_fold(data, 2, lambda: mo.boosted_classifier(depth=2, rounds=3), lambda m, d: mo.probability(m, d, "p"), test=data.limit(10))
    assert oof.count() == 400 and mt.auc(oof, "label", "p").first().auc == 1.0 and sp.fold_mean(tests, "id", "p").count() == 10
    gains = {r.feature: r.gain for r in mo.importances(spark, models, ["x", "z"]).filter("fold = 0").collect()}
    assert gains["x"] > 0.9
    io.save_model(models[0], str(tmp_path / "m"))
    from pyspark.ml.classification import GBTClassificationModel

    assert GBTClassificationModel.load(str(tmp_path / "m")).getNumTrees == 3


def test_stream_of_slots(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = slot_counts(stream, "user_id", "ts", late="400 days").writeStream.outputMode("update").format("memory").queryName("slots").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("slots").groupBy("window_start", "user_id", "slot").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0]
    assert got == events.filter(weekly_slot(F.col("ts").cast("timestamp")).isNotNull()).count()


def direction(z):
    h, w = z.shape
    d = np.zeros((h, w), int)
    for r in range(1, h - 1):
        for c in range(1, w - 1):
            if not np.isnan(z[r, c]):
                drops = [((z[r, c] - z[r + y, c + x]) / math.hypot(y, x), -k) for k, (y, x) in enumerate(D8) if not np.isnan(z[r + y, c + x])]
                d[r, c] = -max(drops)[1] if drops else 0
    return d


def accumulated(z, d):
    h, w = z.shape
    acc = np.ones((h, w))
    for _, r, c in sorted(((z[r, c], r, c) for r in range(h) for c in range(w) if not np.isnan(z[r, c])), reverse=True):
        y, x = r + D8[d[r, c]][0], c + D8[d[r, c]][1]
        if 0 <= y < h and 0 <= x < w:
            acc[y, x] += acc[r, c]
    return acc


def cheapest(cost, r, c):
    best = np.full(cost.shape, np.inf)
    best[r, c] = 0
    heap = [(0.0, r, c)]
    while heap:
        s, r, c = heapq.heappop(heap)
        for dr, dc in D8:
            y, x = r + dr, c + dc
            if 0 <= y < cost.shape[0] and 0 <= x < cost.shape[1] and s + (cost[r, c] + cost[y, x]) / 2 * math.hypot(dr, dc) < best[y, x] - 1e-15:
                best[y, x] = s + (cost[r, c] + cost[y, x]) / 2 * math.hypot(dr, dc)
                heapq.heappush(heap, (best[y, x], y, x))
    return best


def grids(spark, surfaces):
    rows = [(v, r, c, None if math.isnan(a[r, c]) else float(a[r, c])) for v, a in surfaces.items() for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, "village string, row int, col int, value double").repartition(6)


def test_rim_graphs_of_two_villages_on_16_x_16_tiles(spark, monkeypatch):
    """Two grids that overlap in their cells, one of 16 x 16 tiles with four levels of groups, equal the sequential algorithms."""
    monkeypatch.setattr(rims, "FAN", 2)
    monkeypatch.setattr(rims, "COST_FAN", 4)
    rng = np.random.default_rng(21)
    r, c = np.indices((64, 64))
    big = np.round(8 * np.sin(r / 7.0) * np.cos(c / 9.0) + rng.random((64, 64)) * 3 + 0.1 * np.hypot(r - 30, c - 30), 1)  # basins that reach over many tiles
    big[20:23, 40] = big[50, 10:14] = np.nan
    small = rng.integers(0, 6, (11, 18)).astype(float)
    small[4, 5] = np.nan
    surfaces = {"big": big, "small": small}
    filled = te.fill_depressions(grids(spark, surfaces), tile=4, by=["village"])
    level = {v: flooded(a) for v, a in surfaces.items()}
    for v, a in surfaces.items():
        assert np.array_equal(dense(filled.filter(F.col("village") == v), a.shape), level[v], equal_nan=True)
    directed = te.flow_direction(grids(spark, level), by=["village"])
    acc = te.flow_accumulation(directed, tile=4, by=["village"])
    for v, a in level.items():
        d = direction(a)
        assert np.array_equal(dense(directed.filter(F.col("village") == v), a.shape, "d"), d)
        assert np.array_equal(dense(acc.filter(F.col("village") == v), a.shape, "acc"), accumulated(a, d))
    costs = {"big": rng.random((64, 64)) + 0.05, "small": rng.random((11, 18)) + 0.05}
    ends = {"big": (63, 17), "small": (0, 3)}
    outlets = spark.createDataFrame([(v, *e) for v, e in ends.items()], "village string, row int, col int")
    cost = grids(spark, costs).withColumnRenamed("value", "cost")
    dist = te.least_cost(cost, outlets, tile=4, by=["village"])
    for v, a in costs.items():
        assert np.allclose(dense(dist.filter(F.col("village") == v), a.shape, "dist"), cheapest(a, *ends[v]))
    starts = spark.createDataFrame([("big", 1, 2, 60), ("small", 1, 10, 17)], "village string, path int, row int, col int")
    paths = te.trace(cost, dist, starts, tile=16, by=["village"]).collect()
    for v, a in costs.items():
        at = [(p.row, p.col) for p in sorted((p for p in paths if p.village == v), key=lambda p: p.step)]
        assert at[-1] == ends[v]
        total = sum((a[p] + a[q]) / 2 * math.hypot(p[0] - q[0], p[1] - q[1]) for p, q in zip(at[:-1], at[1:], strict=True))
        assert total == pytest.approx(cheapest(a, *ends[v])[at[0]])
    with pytest.raises(Exception, match="no way on"):
        te.trace(cost, dist.withColumn("dist", F.lit(1.0)), starts, tile=16, by=["village"]).collect()


def test_small_tiles_are_worked_on_by_blocks(spark):
    """Tiles of four cells: a task takes a block of 128 x 128 cells, not a tile, and grids that reach over two blocks equal the sequential algorithms."""
    rng = np.random.default_rng(3)
    a = np.round(rng.random((9, 150)) * 9, 1)
    a[3:5, 60] = np.nan
    cells = grids(spark, {"v": a})
    assert rims.tiled(cells.withColumnRenamed("value", "z"), ["z"], ["village"], 4).count() == 2
    level = flooded(a)
    assert np.array_equal(dense(te.fill_depressions(cells, tile=4, by=["village"]), a.shape), level, equal_nan=True)
    directed = te.flow_direction(grids(spark, {"v": level}), by=["village"])
    assert np.array_equal(dense(te.flow_accumulation(directed, tile=4, by=["village"]), a.shape, "acc"), accumulated(level, direction(level)))
    c = rng.random((9, 150)) + 0.05
    cost = grids(spark, {"v": c}).withColumnRenamed("value", "cost")
    dist = te.least_cost(cost, spark.createDataFrame([("v", 8, 149)], "village string, row int, col int"), tile=4, by=["village"])
    assert np.allclose(dense(dist, c.shape, "dist"), cheapest(c, 8, 149))
    path = te.trace(cost, dist, spark.createDataFrame([("v", 1, 0, 2)], "village string, path int, row int, col int"), tile=4, by=["village"]).orderBy("step").collect()
    at = [(p.row, p.col) for p in path]
    assert at[0] == (0, 2) and at[-1] == (8, 149)
    assert sum((c[p] + c[q]) / 2 * math.hypot(p[0] - q[0], p[1] - q[1]) for p, q in zip(at[:-1], at[1:], strict=True)) == pytest.approx(cheapest(c, 8, 149)[0, 2])


def test_cell_percentiles_by_blocks_and_cell_by_cell(spark):
    """Percentiles of cells are Spark's, in blocks that a task sorts and in those with too many points."""
    from prepforge.operators import stencils as st

    x = F.xxhash64("id")
    z = F.when(x % 11 != 0, (F.pmod(x, F.lit(97)) / 7).cast("double"))
    df = spark.range(6000).select((F.col("id") % 2).cast("int").alias("g"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(140)).cast("int").alias("row"), (F.col("id") % 5 + F.when(F.col("id") % 7 == 0, 126).otherwise(0)).cast("int").alias("col"), z.alias("z")).repartition(3)
    df = df.unionByName(spark.createDataFrame([(1, 139, 139, None), (0, 3, 200, 1.5)], df.schema))
    want = {tuple(r) for r in df.groupBy("g", "row", "col").agg(F.percentile("z", 0.05).alias("p05"), F.percentile("z", 0.5).alias("median")).collect()}
    for most in (1_000_000, 300):
        got = st.cell_percentiles(df, {"p05": 0.05, "median": 0.5}, ["g"], most).select("g", "row", "col", "p05", "median").collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_gaps_are_filled_within_blocks_and_from_afar(spark):
    """Gaps near filled cells, over a block's edge, and far from any (a block without cells) equal a full search."""
    rng = np.random.default_rng(8)
    a = np.round(rng.random((20, 300)), 3)
    a[:, 100:280] = np.nan
    a[rng.random(a.shape) < 0.3] = np.nan
    got = dense(te.fill_gaps(cells(spark, a), *a.shape), a.shape)
    r, c = np.nonzero(~np.isnan(a))
    for y, x in [*zip(*np.nonzero(np.isnan(a)), strict=True)][::7]:
        d2 = (r - y) ** 2 + (c - x) ** 2
        at = np.lexsort((c, r, d2))[:8]
        w = 1 / d2[at]
        assert got[y, x] == pytest.approx((w * a[r[at], c[at]]).sum() / w.sum())
    assert not np.isnan(got).any() and np.array_equal(got[r, c], a[r, c])


def test_local_operators_over_blocks_edges(spark):
    """A grid of 2 x 2 blocks whose last ones are narrow: smoothing and slope equal those of the mirrored whole."""
    a = np.random.default_rng(5).random((130, 140))
    w = np.array([math.exp(-0.125 * i * i) for i in range(-8, 9)])
    w /= w.sum()
    pad = np.pad(a, 8, mode="symmetric")
    rows = sum(w[i] * pad[i : i + 130] for i in range(17))
    assert np.allclose(dense(te.gaussian(cells(spark, a), 130, 140, 2.0), a.shape), sum(w[i] * rows[:, i : i + 140] for i in range(17)))
    p = np.pad(a, 1, mode="symmetric")
    sx = sum(k * (p[1 + d : 131 + d, 2:] - p[1 + d : 131 + d, :-2]) for d, k in ((-1, 1), (0, 2), (1, 1)))
    sy = sum(k * (p[2:, 1 + d : 141 + d] - p[:-2, 1 + d : 141 + d]) for d, k in ((-1, 1), (0, 2), (1, 1)))
    got = te.sloped(cells(spark, a), 130, 140, 0.5)
    assert np.allclose(dense(got, a.shape, "slope"), np.maximum(np.hypot(sx / 4, sy / 4), 0.001)) and np.array_equal(dense(got, a.shape, "d"), direction(a))


def test_least_cost_over_groups_of_blocks(spark):
    """Six blocks in a row, settled by groups of one and two, equal the sequential algorithm; walls of empty cells are gone around."""
    c = np.random.default_rng(6).random((7, 700)) + 0.05
    c[1:, 300] = c[:-1, 400] = np.nan
    cost = grids(spark, {"v": c}).withColumnRenamed("value", "cost")
    outlet = spark.createDataFrame([("v", 3, 650)], "village string, row int, col int")
    want = np.where(np.isnan(c), np.inf, cheapest(np.where(np.isnan(c), np.inf, c), 3, 650))
    for fan in (1, 2):
        got = dense(te.least_cost(cost, outlet, 16, ["village"], fan), c.shape, "dist")
        assert np.allclose(got, want)


def test_exact_percentiles_near_the_wanted_places(spark):
    """Large tables are narrowed by a sketch first; percentiles stay exact, of many keys, of repeated values and at both ends."""
    x = F.xxhash64("id")
    v = F.when(x % 13 != 0, F.when(F.col("id") % 3 == 0, F.pmod(x, F.lit(5)).cast("double")).otherwise(F.pmod(x, F.lit(1_000_003)) / 7))
    df = spark.range(60_000).select(F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("g"), v.alias("v"))
    cuts = {"a": 0.0, "b": 0.25, "c": 0.9, "d": 0.95, "e": 1.0}
    want = df.groupBy("g").agg(*[F.percentile("v", s).alias(n) for n, s in cuts.items()]).collect()
    for direct in (100, 10**9):
        got = {r.g: r for r in ra.exact_percentiles(df, "v", cuts, ["g"], direct).collect()}
        assert len(got) == len(want) == 4
        assert all(got[r.g][n] == pytest.approx(r[n], rel=1e-12) for r in want for n in cuts)
        one = ra.exact_percentiles(df, "v", cuts, direct=direct).first()
        assert all(one[n] == pytest.approx(x, rel=1e-12) for n, x in df.agg(*[F.percentile("v", s).alias(n) for n, s in cuts.items()]).first().asDict().items())
