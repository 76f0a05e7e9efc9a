"""Whole flows: catalogue preprocessing and price, send slots, claims, credit, terrain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations
from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.metrics import auc, log_loss, mae, smape
from ..functions.slots import weekly_slot
from ..functions.vectors import CentredPca, all_cross_modal, cosine_by_size
from ..operators import ensemble, models, splits, terrain
from ..operators.columns import from_log, impute, to_log
from ..operators.durable import durable
from ..operators.encode import ClaimEngineer, Scaler
from ..operators.joins import expand_slots, left_history, small
from ..operators.ranks import category_codes, encode_category, rank_slots
from ..operators.stats import slot_counts, slot_matrix
from ..sources import io

CATALOG_ROLES = {"catalog_content": "text", "item_name": "text", "item_description": "text", "item_pack_clean": "text", "pack_value": "numeric", "pack_count": "count", "pack_unit": "categorical", "item_pack": "categorical", "has_pack": "flag", "image_link": "url"}


def preprocess_catalog(train: DataFrame, test: DataFrame | None = None, key: str = "sample_id", target: str = "price", share: float = 0.2, seed: int = 42, unicode: bool = True) -> DataFrame:
    """Parsed, split (train, val, test) and imputed catalogue in one table with a split column."""
    tagged = splits.holdout_by_target(train, key, target, share, seed=seed)
    if test is not None:
        tagged = tagged.unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True)
    return impute(tx.clean_pack(tx.parse_catalog(tagged, unicode=unicode), unicode=unicode), CATALOG_ROLES)


def price_makers(rounds: int) -> dict:
    """Three families of price models on log prices; each takes the name of a weight column, or None."""
    return {
        "gbt_abs": lambda w=None: models.boosted_regressor(rounds=rounds, weight=w),
        "gbt_sq": lambda w=None: models.boosted_regressor(loss="squared", depth=6, rounds=rounds, weight=w),
        "forest": lambda w=None: models.forest(trees=3 * rounds, weight=w),
    }


def price_models(df: DataFrame, columns: Sequence[str], price: str, key: str, folds: int = 3, rounds: int = 8, test: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Out-of-fold log predictions of three models (boosted L1, boosted squared, forest), and those of test as means over the folds' models."""
    rows = durable(splits.k_fold(models.assemble(df, columns).withColumn("label", to_log(price)).select(key, price, "label", "features"), key, folds))
    others = durable(models.assemble(test, columns).select(key, "features")) if test is not None else None
    out, scored = rows.select(key, price, "label"), None
    for name, make in price_makers(rounds).items():
        oof, _, tests = models.out_of_fold(rows, folds, make, lambda m, d, name=name: models.predicted(m, d, name), others)
        out = out.join(durable(oof.select(key, name)), key)
        if others is not None:
            mean = durable(splits.fold_mean(tests, key, name))
            scored = mean if scored is None else scored.join(mean, key)
    return out, scored


def price_flow(df: DataFrame, columns: Sequence[str], price: str, key: str, folds: int = 3, rounds: int = 8) -> DataFrame:
    """Blended out-of-fold prices with the weights that the grid search finds best."""
    oof = durable(price_models(df, columns, price, key, folds, rounds)[0])
    names = list(price_makers(rounds))
    top = ensemble.best(ensemble.search_weights(oof, names, price, ensemble.weight_grid()), "smape").first()
    return oof.select(key, price, from_log(sum((F.col(c) * top[f"w_{c}"] for c in names), F.lit(0.0)), safe=True).alias("predicted"))


class PriceRun(NamedTuple):
    """fused: key, split, target and all features; oof: key, target, predicted; submission: key, price of every test row; weights of the blend, its smape, and the features that the retraining kept."""

    fused: DataFrame
    oof: DataFrame
    submission: DataFrame
    weights: dict[str, float]
    smape: float
    kept: list[str]


def fused_catalog(train: DataFrame, test: DataFrame, vectors: Mapping[str, DataFrame], key: str = "sample_id", target: str = "price", components: int = 128, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """One durable table of split, target and features of a catalogue, and the names of its feature columns.

    Texts are parsed and imputed; vector blocks (name to a table of key and vector) are joined by key, reduced by a PCA that is fitted on
    training rows, and compared with each other; text and pack features, brand counts of training rows, and parts of the vectors follow. A row
    without a vector has nulls there.
    """
    rows = durable(preprocess_catalog(train, test, key, target, seed=seed))
    rows = tx.tier1(rows, tx.brand_counts(rows.filter("split = 'train'"), "item_name"))
    blocks = {name: min(components, len(block.select("vector").first().vector)) for name, block in vectors.items()}
    for name, block in vectors.items():
        own = block.select(F.col("key").alias(key), F.col("vector").alias(f"__{name}"))
        rows = durable(rows.join(own, key, "left"))
        have = rows.filter(F.col(f"__{name}").isNotNull())
        pca = CentredPca(have.filter("split = 'train'"), f"__{name}", blocks[name])
        rows = rows.drop(f"__{name}").join(durable(pca.transform(have.select(key, f"__{name}"), name).select(key, name)), key, "left")
    pairs = list(combinations(vectors, 2))
    rows = all_cross_modal(rows, pairs)
    crossed = [c for a, b in pairs for c in (f"{a}_{b}_cos", f"{a}_{b}_norm_a", f"{a}_{b}_norm_b", f"{a}_{b}_norm_ratio")]
    parts = {f"{name}_{i}": F.col(name)[i] for name, n in blocks.items() for i in range(n)}
    text = ["pack_count_c", "pack_value_c", "is_single_pack", "pack_count_x_value", "log_count_div_value", *tx.complexity("item_name"), *tx.numbers("item_name"), *tx.keywords("item_name"), "brand_freq"]
    scaled = {f"{a}_{b}_cos_by_size": cosine_by_size(f"{a}_{b}_cos", "pack_value") for a, b in pairs}
    names = [*text, *crossed, *scaled, *parts]
    return durable(rows.withColumns(parts | scaled).select(key, "split", target, *names)), names


def catalog_price_flow(train: DataFrame, test: DataFrame, vectors: Mapping[str, DataFrame], key: str = "sample_id", target: str = "price", components: int = 128, folds: int = 5, rounds: int = 50, limit: float = 0.05, weight: float = 0.5, share: float = 0.8, seed: int = 42) -> PriceRun:
    """From raw catalogue texts and vectors to a price for each test row.

    Features of all rows in one table, out-of-fold predictions of three families on training and validation rows, blend weights by grid
    search, test rows on which the families agree (deviation of log prices below limit) as pseudo-labelled rows, and a blend of the models that
    are trained again with these on pruned features.
    """
    fused, names = fused_catalog(train, test, vectors, key, target, components, seed)
    known, rest = fused.filter("split <> 'test'"), fused.filter("split = 'test'").drop(target)
    oof, _ = price_models(known, names, target, key, folds, rounds)
    oof, families = durable(oof), list(price_makers(rounds))
    top = ensemble.best(ensemble.search_weights(oof, families, target, ensemble.weight_grid()), "smape").first()
    weights = {c: top[f"w_{c}"] for c in families}
    blend = lambda: from_log(sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)), safe=True)
    again = models.retrain_with_pseudo(known.withColumn("__log", to_log(target)), rest, names, key, "__log", price_makers(rounds), folds, limit, weight, share)
    submission = again.predictions.select(key, blend().alias(target))
    return PriceRun(fused, oof.select(key, target, blend().alias("predicted")), submission, weights, top["smape"], again.kept)


def single_split_price(df: DataFrame, columns: Sequence[str], price: str, key: str, share: float = 0.2, rounds: int = 50, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """One boosted model on the training part of a split that is stratified by price, stopped by the rest: key, price, split, predicted of all rows, and mae and smape by split."""
    held = splits.holdout_by_target(df, key, price, share, seed=seed).withColumn("stop", F.col("split") == "val")
    rows = durable(models.assemble(held, columns).withColumn("label", to_log(price)).select(key, price, "split", "stop", "label", "features"))
    model = models.boosted_regressor(rounds=rounds, stop="stop", seed=seed).fit(rows)
    out = durable(models.predicted(model, rows, "__log").select(key, price, "split", from_log("__log", safe=True).alias("predicted")))
    return out, out.groupBy("split").agg(F.round(mae(price, "predicted"), 6).alias("mae"), F.round(smape(price, "predicted"), 6).alias("smape"))


def slot_features(events: DataFrame, key: str, sent: str, opened: str, slots: int = 28) -> DataFrame:
    """Send slot, open slot, and the key's engagement counts; keys without opens keep nulls."""
    rows = events.withColumns({"send_slot": weekly_slot(sent), "open_slot": weekly_slot(opened)})
    return left_history(rows, slot_matrix(rows.select(key, F.col("open_slot").alias("slot")), key, slots=slots), key)


def slot_history_ranking(events: DataFrame, key: str, ts: str) -> DataFrame:
    """Weekly slots of each key by engagement, most first, ties to the earlier slot."""
    slotted = events.withColumn("slot", weekly_slot(ts))
    return rank_slots(slot_counts(slotted, key), key, "slot", "n")


SLOT_FEATURES = ("slot", "rest", "slot_n", "day", "part", "key_n", "kind")


def _slot_events(events: DataFrame, ts: str) -> DataFrame:
    return events.withColumn("slot", weekly_slot(ts)).filter("slot is not null")


def _slot_rows(slotted: DataFrame, keys: DataFrame, priors: DataFrame, codes: DataFrame, key: str, positive: str, kind: str) -> DataFrame:
    """Every key with every slot: whether it engaged there, its other counts, all keys' count of the slot (from training), and the code of its commonest kind of event."""
    counts = slotted.groupBy(key, "slot").agg(F.count("*").alias("n"), F.sum((F.col(kind) == positive).cast("int")).alias("hits"))
    pairs = left_history(expand_slots(keys, key), counts, [key, "slot"]).fillna(0, ["n", "hits"])
    kinds = slotted.groupBy(key, kind).agg(F.count("*").alias("c")).groupBy(key).agg(F.max_by(kind, F.struct("c", kind)).alias("__kind"), F.sum("c").alias("key_n"))
    rows = pairs.join(encode_category(kinds, codes, "__kind", "kind").select(key, "kind", "key_n"), key, "left").fillna({"kind": -1, "key_n": 0})
    rows = rows.join(F.broadcast(priors), "slot", "left").fillna(0, ["slot_n"])  # a row for each slot
    return rows.withColumns({"label": (F.col("hits") > 0).cast("int"), "rest": F.col("key_n") - F.col("n"), "day": F.floor((F.col("slot") - 1) / 4), "part": F.pmod(F.col("slot") - 1, F.lit(4))})


def _slot_statistics(slotted: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    return slotted.groupBy("slot").agg(F.count("*").alias("slot_n")), category_codes(slotted, kind)


def slot_flow(events: DataFrame, key: str, ts: str, positive: str, kind: str = "event_type", folds: int = 5, rounds: int = 10) -> DataFrame:
    """Every key's 28 slots ranked by a model of whether the key engages in a slot, that was trained on other keys."""
    slotted = _slot_events(events, ts)
    priors, codes = _slot_statistics(slotted, kind)
    rows = splits.group_k_fold(_slot_rows(slotted, slotted.select(key), priors, codes, key, positive, kind), key, folds)
    data = durable(models.assemble(rows, SLOT_FEATURES).select(key, "slot", "label", "fold", "features"))
    scored, _, _ = models.out_of_fold(data, folds, lambda: models.boosted_classifier(depth=4, rounds=rounds), lambda m, d: models.probability(m, d, "p"))
    return rank_slots(scored, key, "slot", "p")


def train_slots(events: DataFrame, path: str, key: str, ts: str, positive: str, kind: str = "event_type", rounds: int = 10) -> None:
    """Trains the slot model on events and writes it under path, with what scoring needs: the category codes, the slots' counts and the columns' names."""
    slotted = _slot_events(events, ts)
    priors, codes = (durable(x) for x in _slot_statistics(slotted, kind))
    rows = _slot_rows(slotted, slotted.select(key), priors, codes, key, positive, kind)
    model = models.boosted_classifier(depth=4, rounds=rounds).fit(durable(models.assemble(rows, SLOT_FEATURES).select("label", "features")))
    io.save_model(model, f"{path}/model")
    io.write_parquet(priors, f"{path}/priors")
    io.write_parquet(codes, f"{path}/codes")
    io.write_metadata(events.sparkSession, {"key": key, "ts": ts, "positive": positive, "kind": kind, "features": ",".join(SLOT_FEATURES)}, f"{path}/metadata")


def score_slots(events: DataFrame, template: DataFrame, path: str) -> DataFrame:
    """template with every key's slots ranked by the model under path. events are those known of the keys now; keys without any are ranked by the slots' counts alone; rows of template keep all their columns."""
    spark = events.sparkSession
    told = io.read_metadata(spark, f"{path}/metadata")
    priors, codes, key, kind = spark.read.parquet(f"{path}/priors"), spark.read.parquet(f"{path}/codes"), told["key"], told["kind"]
    rows = _slot_rows(_slot_events(events, told["ts"]), template.select(key), priors, codes, key, told["positive"], kind)
    scored = models.probability(GBTClassificationModel.load(f"{path}/model"), models.assemble(rows, told["features"].split(",")), "p")
    return template.join(rank_slots(scored, key, "slot", "p"), key, "left")


def _credit_models(df: DataFrame, key: str, label: str, columns: Sequence[str], folds: int, rounds: int) -> tuple[DataFrame, DataFrame, list]:
    """Rows with fold and cell, counted cells, and the folds' models."""
    df = df.select(key, F.col(label).alias("label"), *columns)
    rows = splits.stratified_k_fold(Scaler(df, columns).transform(df), key, "label", folds)
    data = models.binned(rows, columns).select(key, "label", "fold", "cell")
    # rows of one cell are alike to the trees: they are trained on once, with their number
    return data, *models.fold_models(models.by_fold(data, folds, "cell", "label"), len(columns), folds, lambda n: models.boosted_classifier(depth=4, rounds=rounds, weight="n", total=n))


def _credit_scores(data: DataFrame, made: list, width: int) -> DataFrame:
    return models.scored_by_fold(data, made, width, "score").withColumn("score", F.bround("score", 6))


def credit_oof(df: DataFrame, key: str, label: str, columns: Sequence[str], folds: int = 10, rounds: int = 5) -> DataFrame:
    """Out-of-fold scores after scaling."""
    data, _, made = _credit_models(df, key, label, columns, folds, rounds)
    return _credit_scores(data, made, len(columns))


def credit_flow(df: DataFrame, key: str, label: str, columns: Sequence[str], folds: int = 10, rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold scores after scaling, and auc and log loss of each fold."""
    data, cells, made = _credit_models(df, key, label, columns, folds, rounds)
    oof = _credit_scores(data, made, len(columns))
    counts = models.out_of_fold_counts(cells, made, "score").groupBy("fold", "label", F.bround("score", 6).alias("score")).agg(F.sum("n").alias("n"))
    counts = durable(counts)
    parts = [counts.filter(F.col("fold") == k) for k in range(folds)]
    rows = [auc(c, "label", "score", "n").crossJoin(c.agg(F.round(log_loss("label", "score", n="n"), 9).alias("log_loss"))).withColumn("fold", F.lit(k)) for k, c in enumerate(parts)]  # one row each
    scores = rows[0]
    for r in rows[1:]:
        scores = scores.unionByName(r)
    return oof, scores


def claim_flow(df: DataFrame, key: str, label: str, frequency: str, numeric: Sequence[str], folds: int = 5, rounds: int = 5) -> DataFrame:
    """Out-of-fold scores of two models, their rank average, and the blended score: key, label, a, b, final.

    Both models are fitted on all training rows: equal ones once, weighted by their number. A leaf's least five rows are counted by weight.
    """
    raw = [frequency, *numeric]
    rows = durable(splits.stratified_k_fold(df.select(key, label, *raw), key, label, folds).withColumn("__raw", F.struct(*raw)).drop(*raw))
    # rows that are alike to both models are met once, with their number in each fold
    alike = durable(rows.groupBy("__raw", F.col(label).alias("label")).agg(*[F.sum((F.col("fold") == k).cast("long")).alias(f"__n{k}") for k in range(folds)]).sortWithinPartitions("__raw", "label"))
    names = [*numeric, f"eng_{numeric[0]}_x_{numeric[1]}", f"eng_{numeric[0]}_div_{numeric[1]}", f"eng_{numeric[0]}_is_missing", f"{frequency}_freq"]
    parts = []
    for k in range(folds):
        others = sum((F.col(f"__n{j}") for j in range(folds) if j != k), F.lit(0))
        train = alike.select("__raw.*", "label", others.alias("__n")).filter("__n > 0")
        held = alike.groupBy("__raw").agg(F.sum(f"__n{k}").alias("__n")).filter("__n > 0").select("__raw", "__raw.*", "__n")
        eng = ClaimEngineer(train, frequency, products=[(numeric[0], numeric[1])], ratios=[(numeric[0], numeric[1])], flags=[numeric[0]], number="__n")
        x, y = (models.assemble(eng.transform(d), names) for d in (train, held))
        x = durable(models.positive_weight(x, "label", number="__n"))
        total = x.agg(F.sum("weight")).first()[0] or 0
        scored = models.probability(models.boosted_classifier(depth=4, rounds=rounds, weight="weight", total=total).fit(x), y, "a")
        scored = models.probability(models.logistic_meta(x.drop("features"), names, "label", number="__n"), scored, "b")
        parts.append(scored.select(F.lit(k).alias("fold"), "__raw", "__n", "a", "b"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    final = durable(ensemble.rank_average(durable(every), ["a", "b"], "final", "__n").drop("__n"))
    return rows.join(small(final), ["fold", "__raw"]).select(key, label, "a", "b", "final")


class TerrainProducts(NamedTuple):
    """Grids of a point cloud, and what tells them apart: by, and for several villages the columns of their numbers of rows and columns. surface: value (filled depressions), slope, acc and twi of every cell; raster: cells that have points."""

    meta: DataFrame
    surface: DataFrame
    by: tuple[str, ...]
    raster: DataFrame


def terrain_products(points: DataFrame, res: float, stat: str = "p05", tile: int = terrain.TILE, by: Sequence[str] = ()) -> TerrainProducts:
    """Terrain, filled depressions, slope, flow and wetness; with by, of the grids of all villages together, each with a definition of its own."""
    dtm, meta, raster = terrain.raster_dtm(points, res, stat, by=by)
    keys = (*by, "nrows", "ncols") if by else ()
    rows, columns = ("nrows", "ncols") if by else (meta.first().nrows, meta.first().ncols)
    filled = terrain.fill_depressions(durable(dtm), tile, keys)
    drained = terrain.flow_accumulation(durable(terrain.sloped(filled, rows, columns, res, 0.001, keys)), tile, keys, ("slope",))
    return TerrainProducts(meta, durable(terrain.wet(drained, rows, columns, res, 2.0, keys)), keys, raster)


def terrain_hot_spots(points: DataFrame, res: float, stat: str = "p05", tile: int = terrain.TILE, by: Sequence[str] = ()) -> DataFrame:
    """Risk table of a point cloud: terrain, filled depressions, flow, wetness, levels; with by, of all villages in one run."""
    p = terrain_products(points, res, stat, tile, by)
    return terrain.risk_levels(p.surface, p.by).drop("nrows", "ncols")


def _report_lines(df: DataFrame, section: str, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    values = F.array(*[F.struct(F.lit(n).alias("name"), F.round(F.col(n).cast("double"), 6).alias("value")) for n in names])
    return df.select(*by, F.lit(section).alias("section"), F.explode(values).alias("l")).select(*by, "section", "l.name", "l.value")


def terrain_report(points: DataFrame, res: float, stat: str = "p05", tile: int = terrain.TILE, paths: int = 10, apart: float = 50.0, by: Sequence[str] = ()) -> DataFrame:
    """section, name and value of a point cloud's report, for each village with by: points and coverage, heights, hectares at risk, channels, and the checks of these."""
    p = terrain_products(points, res, stat, tile, by)
    size = p.meta.select(*by, (F.col("nrows").cast("long") * F.col("ncols")).alias("__cells"))
    heights = p.raster.groupBy(*by).agg(F.count("*").alias("filled_cells"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).withColumn("range", F.col("high") - F.col("low"))
    known = points.groupBy(*by).agg(F.count("*").alias("points"))
    side_by_side = lambda a, b: a.join(b, list(by)) if by else a.crossJoin(b)  # noqa: E731  one row for each village
    cover = durable(side_by_side(side_by_side(heights, size), known).withColumn("coverage_pct", 100 * F.col("filled_cells") / F.col("__cells")))
    risk = terrain.hectares(terrain.risk_levels(p.surface, p.by), res, by)
    ways = terrain.drainage(p.surface, None, p.surface, paths, apart, tile, p.by)
    lines = durable(terrain.lengths(terrain.polylines(ways, 0.0, 0.0, res, by), by))
    lists = ((cover, "points", ("points", "filled_cells", "coverage_pct")), (cover, "heights", ("low", "high", "mean", "range", "std")), (risk, "risk", ("moderate_ha", "high_ha", "critical_ha")), (lines, "channels", ("channels", "total", "mean", "min", "max")))
    out = None
    for df, section, names in lists:
        part = _report_lines(df, section, names, by)
        out = part if out is None else out.unionByName(part)
    metrics = side_by_side(cover.select(*by, "coverage_pct", "range", "std"), lines.select(*by, F.col("channels").alias("paths")))
    checks = terrain.village_checks(metrics.withColumn("village", F.col(by[0]) if by else F.lit(0)))
    checks = checks.select(*([F.col("village").alias(by[0])] if by else []), F.lit("checks").alias("section"), F.col("rule").alias("name"), F.col("pass").cast("double").alias("value"))
    return out.unionByName(checks)
