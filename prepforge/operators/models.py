"""Distributed training with Spark ML: boosted trees, forests, linear meta-learners; folds, out-of-fold tables, importances."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .ensemble import confident
from .joins import small, with_pseudo
from .ranks import cumulative_share, exact_percentiles
from .stats import mean_importance


def assemble(df: DataFrame, columns: Sequence[str], fill: float = -1.0) -> DataFrame:
    """features from numeric columns; ML vectors take no nulls, so these become fill."""
    named = df.withColumns({f"__f_{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(fill)) for c in columns})
    return VectorAssembler(inputCols=[f"__f_{c}" for c in columns], outputCol="features").transform(named).drop(*[f"__f_{c}" for c in columns])


def boosted_regressor(label: str = "label", loss: str = "absolute", depth: int = 5, rounds: int = 50, weight: str | None = None, stop: str | None = None, seed: int = 42) -> GBTRegressor:
    """L1 or squared loss, with feature and row sampling; stop names a boolean column of the rows that decide when to stop."""
    m = GBTRegressor(labelCol=label, lossType=loss, maxDepth=depth, maxIter=rounds, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=5, seed=seed)
    m = m.setWeightCol(weight) if weight else m
    return m.setValidationIndicatorCol(stop) if stop else m


def forest(label: str = "label", depth: int = 8, trees: int = 60, weight: str | None = None, seed: int = 42) -> RandomForestRegressor:
    """A regressor of another family, for diversity."""
    m = RandomForestRegressor(labelCol=label, maxDepth=depth, numTrees=trees, subsamplingRate=0.8, seed=seed)
    return m.setWeightCol(weight) if weight else m


def boosted_classifier(label: str = "label", depth: int = 5, rounds: int = 50, weight: str | None = None, stop: str | None = None, seed: int = 42, total: float | None = None) -> GBTClassifier:
    """total: the sum of the weights, where these are numbers of rows; a leaf's least five rows are then counted by weight."""
    m = GBTClassifier(labelCol=label, maxDepth=depth, maxIter=rounds, stepSize=0.1, subsamplingRate=0.8, minInstancesPerNode=5, seed=seed)
    m = m.setWeightCol(weight) if weight else m
    m = least_by_weight(m, total) if total is not None else m
    return m.setValidationIndicatorCol(stop) if stop else m


def least_by_weight(model, total: float):
    """model with a leaf's least rows counted by weight; total: the sum of the weights, which are numbers of rows."""
    least = model.getMinInstancesPerNode()
    return model.setMinInstancesPerNode(1).setMinWeightFractionPerNode(min(least / max(total, 1), 0.49)) if least > 1 else model


#: Bins of a column, as many as the trees tell apart, and the bits of a bin's number.
BINS, BIN_BITS = 32, 5


def binned(df: DataFrame, columns: Sequence[str], out: str = "cell", fill: float = -1.0) -> DataFrame:
    """out (long) holds the bins of at most 12 numeric columns: each value its own where they are few, else between exact percentiles of all rows. Nulls become fill.

    Trees split between bins only, so rows of one cell are alike to them.
    """
    columns = list(columns)
    if len(columns) * BIN_BITS > 60:
        raise ValueError("at most 12 columns")
    value = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(fill))
    # all columns' values are counted in one pass
    each = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), value(c).alias("v")) for i, c in enumerate(columns)])).alias("e")).select("e.i", "e.v")
    counts = durable(each.groupBy("i", "v").agg(F.count("*").alias("n")))
    many = {r.i for r in counts.groupBy("i").count().filter(F.col("count") > BINS).collect()}  # a row a column
    edges = {}
    for r in counts.filter(~F.col("i").isin(many)).groupBy("i").agg(F.array_sort(F.collect_set("v")).alias("v")).collect():
        edges[r.i] = r.v[:-1]
    if many:
        for r in exact_percentiles(counts.filter(F.col("i").isin(many)), "v", {f"e{k}": k / BINS for k in range(1, BINS)}, ["i"], number="n").collect():
            edges[r.i] = sorted(set(r[1:]))
    cell = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        cell = cell + F.shiftleft(_bin(value(c), edges.get(i, [])).cast("long"), BIN_BITS * i)
    return df.withColumn(out, cell)


def _bin(value: Column, edges: Sequence[float], first: int = 0) -> Column:
    """How many of the sorted edges lie below value, by halving."""
    if not edges:
        return F.lit(first)
    mid = len(edges) // 2
    return F.when(value > edges[mid], _bin(value, edges[mid + 1 :], first + mid + 1)).otherwise(_bin(value, edges[:mid], first))


def cell_features(df: DataFrame, width: int, cell: str = "cell") -> DataFrame:
    """features: the bins of a cell of width columns."""
    return df.withColumn("features", array_to_vector(F.array(*[F.shiftright(cell, BIN_BITS * i).bitwiseAND(F.lit(BINS - 1)).cast("double") for i in range(width)])))


def counted(df: DataFrame, *columns: str) -> DataFrame:
    """Equal rows of columns once, with their number n: what is trained with n as weight is trained on all rows."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def out_of_fold_cells(cells: DataFrame, width: int, folds: int, make: Callable[[float], object], out: str) -> tuple[DataFrame, list]:
    """fold, cell, label, n and the chance of label 1 in out by the model of the other folds, and the models. cells are counted rows of fold, cell and label; make takes the number of rows."""
    data = durable(cell_features(cells, width))
    size = {r.fold: r.s for r in data.groupBy("fold").agg(F.sum("n").alias("s")).collect()}
    every = sum(size.values())
    parts, models = [], []
    for k in range(folds):
        models.append(make(every - size.get(k, 0)).fit(data.filter(F.col("fold") != k)))
        parts.append(probability(models[-1], data.filter(F.col("fold") == k), out).select("fold", "cell", "label", "n", out))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    return durable(scored), models


def by_fold(df: DataFrame, folds: int, *columns: str) -> DataFrame:
    """Equal rows of columns once, with their number in each fold (n0, n1, ...), in an order of their own."""
    return df.groupBy(*columns).agg(*[F.sum((F.col("fold") == k).cast("long")).alias(f"n{k}") for k in range(folds)]).sortWithinPartitions(*columns)


def fold_models(cells: DataFrame, width: int, folds: int, make: Callable[[float], object]) -> tuple[DataFrame, list]:
    """cells with features (durable), and a model for each fold of the rows of the others. cells are counted rows of cell and label with their number in each fold, as by_fold gives them: what is trained on does not grow with the folds. make takes the number of rows."""
    every = sum((F.col(f"n{k}") for k in range(folds)), F.lit(0))
    data = durable(cell_features(cells, width))
    size = [n or 0 for n in data.agg(*[F.sum(f"n{k}") for k in range(folds)]).first()]
    train = lambda k: data.select("features", "label", (every - F.col(f"n{k}")).cast("double").alias("n")).filter("n > 0")
    return data, [make(sum(size) - size[k]).fit(train(k)) for k in range(folds)]


def out_of_fold_counts(data: DataFrame, models: Sequence, out: str) -> DataFrame:
    """fold, cell, label, n and the chance of label 1 in out by each fold's model, of what fold_models gives (durable)."""
    scored = None
    for k, model in enumerate(models):
        held = probability(model, data.filter(F.col(f"n{k}") > 0).select("cell", "label", F.col(f"n{k}").alias("n"), "features"), out).select(F.lit(k).alias("fold"), "cell", "label", "n", out)
        scored = held if scored is None else scored.unionByName(held)
    return durable(scored)


def _arrays(tree) -> tuple[np.ndarray, ...]:
    """A tree of a Spark model as arrays by node: feature (-1: leaf), threshold, left, right, prediction."""
    rows: list[list] = []

    def add(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, at, at, node.prediction()])
        if node.subtreeDepth() > 0:
            split = node.split()
            rows[at][:2] = split.featureIndex(), split.threshold()
            rows[at][2], rows[at][3] = add(node.leftChild()), add(node.rightChild())
        return at

    add(tree._java_obj.rootNode())
    return tuple(np.array(x) for x in zip(*rows, strict=True))


def scored_by_fold(rows: DataFrame, models: Sequence, width: int, out: str, cell: str = "cell") -> DataFrame:
    """rows with the chance of label 1 in out by the boosted classifier of the row's fold (cell becomes out): each row by itself in one pass, nothing is joined."""
    held = [[(w, m.trees[i].getMaxDepth(), _arrays(m.trees[i])) for i, w in enumerate(m.treeWeights)] for m in models]
    known = rows.sparkSession.sparkContext.broadcast(held)  # a few nodes a tree

    def run(batches):
        for b in batches:
            at, fold = (b.column(b.schema.get_field_index(c)).to_numpy() for c in (cell, "fold"))
            margin = np.zeros(len(at))
            for k in np.unique(fold):
                own = np.flatnonzero(fold == k)
                bins = np.stack([at[own] >> (BIN_BITS * i) & (BINS - 1) for i in range(width)])
                for weight, depth, (feature, threshold, left, right, prediction) in known.value[k]:
                    node = np.zeros(len(own), np.int64)
                    for _ in range(depth):
                        low = bins[feature[node], np.arange(len(own))] <= threshold[node]
                        node = np.where(low, left[node], right[node])
                    margin[own] += weight * prediction[node]
            columns = {n: b.column(i) for i, n in enumerate(b.schema.names) if n != cell} | {out: pa.array(1 / (1 + np.exp(-2 * margin)))}
            yield pa.RecordBatch.from_pydict(columns)

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != cell) + f", `{out}` double"
    return rows.mapInArrow(run, schema)


def with_scores(rows: DataFrame, scored: DataFrame, out: str, *keys: str) -> DataFrame:
    """rows with the score that their cell has: one row of scored for each of keys."""
    return rows.join(small(scored.groupBy(*keys).agg(F.first(out).alias(out))), list(keys))


def probability(model, df: DataFrame, out: str) -> DataFrame:
    """The model's chance of label 1 for all rows, partition by partition."""
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def predicted(model, df: DataFrame, out: str) -> DataFrame:
    return model.transform(df).withColumnRenamed("prediction", out)


def positive_weight(df: DataFrame, label: str, out: str = "weight", number: str | None = None) -> DataFrame:
    """Negatives over positives as the weight of positives. number: a column of how many equal rows a row stands for; the weight is that of all of them."""
    many = F.col(number) if number else F.lit(1)
    n = df.agg(F.sum((F.col(label) == 0).cast("int") * many).alias("n0"), F.sum((F.col(label) == 1).cast("int") * many).alias("n1")).first()
    return df.withColumn(out, F.when(F.col(label) == 1, (n.n0 or 0) / max(n.n1 or 0, 1)).otherwise(1.0) * many)


def out_of_fold(df: DataFrame, folds: int, make: Callable[[], object], apply: Callable[[object, DataFrame], DataFrame], test: DataFrame | None = None, early: str | None = None):
    """Predictions of each fold's rows by the model of the others, the models, and each model's predictions of test with its fold.

    With early, that boolean column marks the fold's own rows for early stopping.
    """
    parts, models, tests = [], [], []
    for k in range(folds):
        train = df.withColumn(early, F.col("fold") == k) if early else df.filter(F.col("fold") != k)
        model = make().fit(train)
        models.append(model)
        parts.append(apply(model, df.filter(F.col("fold") == k)))
        if test is not None:
            tests.append(apply(model, test).withColumn("fold", F.lit(k)))
    union = lambda x: None if not x else x[0] if len(x) == 1 else x[0].unionByName(union(x[1:]))
    return union(parts), models, union(tests)


def importances(spark, models: Sequence, names: Sequence[str]) -> DataFrame:
    """fold, feature, gain and split (how many trees of the model use the feature)."""
    rows = []
    for k, m in enumerate(models):
        used = [0] * len(names)
        for t in getattr(m, "trees", []):
            for i in t.featureImportances.indices if hasattr(t.featureImportances, "indices") else range(len(names)):
                used[int(i)] += 1
        gain = m.featureImportances.toArray().tolist()
        rows += [(k, n, float(g), float(u)) for n, g, u in zip(names, gain, used, strict=True)]
    return spark.createDataFrame(rows, "fold int, feature string, gain double, split double")


def logistic_meta(df: DataFrame, columns: Sequence[str], label: str, c: float = 1.0, number: str | None = None):
    """Logistic regression on predictions; c is the inverse penalty of the whole sample, as other libraries count it. number: a column of how many equal rows a row stands for."""
    n = max(df.agg(F.sum(number)).first()[0] or 0 if number else df.count(), 1)
    model = LogisticRegression(labelCol=label, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False)
    return (model.setWeightCol(number) if number else model).fit(assemble(df, columns))


class ElasticPath(NamedTuple):
    """Scores by fold means, and the best penalty's coefficients on all rows."""

    scores: DataFrame
    alpha: float
    l1: float
    coefficients: list[float]
    intercept: float

    def predict(self, columns: Sequence[str]) -> Column:
        return sum((F.col(c).cast("double") * w for c, w in zip(columns, self.coefficients, strict=True)), F.lit(self.intercept))


def fold_moments(df: DataFrame, columns: Sequence[str], label: str, folds: int, fold: str = "fold") -> np.ndarray:
    """For each fold the sums of products of (1, columns, label), in one pass: a task hands on one matrix for each fold. Rows with a null count for nothing."""
    width = len(columns) + 2

    def sums(batches):
        total = np.zeros((folds, width, width))
        for b in batches:
            at, *values = (c.to_numpy() for c in b.columns)
            x = np.column_stack([np.ones(len(at)), *values])
            for k in range(folds):
                own = x[at == k]
                total[k] += own.T @ own
        yield pa.record_batch([np.arange(total.size), total.ravel()], names=["i", "s"])

    rows = df.select(F.col(fold).cast("int").alias("f"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*columns, label])])
    rows = rows.filter(" and ".join(f"{c} is not null" for c in rows.columns))
    out = np.zeros(folds * width * width)
    for r in rows.mapInArrow(sums, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():  # a number for each pair of columns and fold
        out[r.i] = r.s
    return out.reshape(folds, width, width)


def _descent(m: np.ndarray, alpha: float, l1: float, start: np.ndarray, tol: float, most: int) -> np.ndarray:
    """Coefficients that minimise the mean squared error / 2 + alpha (l1 |w| + (1 - l1) w^2 / 2), by coordinates, from moments m of (1, columns, label)."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    c = m[1:, 1:] / n - np.outer(mean, mean)
    gram, cross, w = c[:-1, :-1], c[:-1, -1], start.copy()
    for _ in range(most):
        moved = 0.0
        for j in range(len(w)):
            if gram[j, j] <= 0:
                continue
            rest = cross[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - alpha * l1, 0.0) / (gram[j, j] + alpha * (1 - l1))
            moved = max(moved, abs(new - w[j]) * gram[j, j] ** 0.5)
            w[j] = new
        if moved <= tol * max(c[-1, -1] ** 0.5, 1e-300):
            break
    return w


def elastic_path(df: DataFrame, columns: Sequence[str], label: str, fold: str = "fold", folds: int = 5, alphas: Sequence[float] | None = None, l1s: Sequence[float] = (0.1, 0.3, 0.5, 0.7, 0.9), tol: float = 1e-9, most: int = 20_000) -> ElasticPath:
    """The best of all penalties and mixes by cross-validation: one pass over the rows, then coordinate descent along falling penalties on the folds' moments.

    By default 50 penalties from 10 down to 0.001. fold holds 0 to folds - 1.
    """
    alphas = sorted(np.logspace(-3, 1, 50).tolist() if alphas is None else alphas, reverse=True)
    parts = fold_moments(df, columns, label, folds, fold)
    every = parts.sum(axis=0)
    rows = []
    for l1 in l1s:
        starts = [np.zeros(len(columns))] * folds
        for alpha in alphas:
            errors = []
            for k in range(folds):
                train, held = every - parts[k], parts[k]
                if held[0, 0] == 0 or train[0, 0] == 0:
                    continue
                w = starts[k] = _descent(train, alpha, l1, starts[k], tol, most)
                v = np.r_[-(train[0, -1] - w @ train[0, 1:-1]) / train[0, 0], -w, 1.0]  # what is left of (1, columns, label)
                errors.append(float(v @ held @ v) / held[0, 0])
            rows.append((float(alpha), float(l1), float(np.mean(errors)) if errors else float("nan")))
    alpha, l1, _ = min(rows, key=lambda r: (r[2], -r[0], r[1]))
    w = np.zeros(len(columns))
    for a in (a for a in alphas if a >= alpha):
        w = _descent(every, a, l1, w, tol, most)
    scores = df.sparkSession.createDataFrame([(a, b, max(e, 0.0) ** 0.5) for a, b, e in rows], "alpha double, l1 double, rmse double")
    return ElasticPath(scores, alpha, l1, w.tolist(), float((every[0, -1] - w @ every[0, 1:-1]) / every[0, 0]))


def _joined(parts: Sequence[DataFrame], key: str) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key)
    return out


class PseudoRetraining(NamedTuple):
    """Features that were kept, pseudo-labelled rows with their label, and predictions (key, a column for each model, predicted, and agreed: the label of pseudo-labelled rows, else null) of all unlabelled rows."""

    kept: list[str]
    pseudo: DataFrame
    predictions: DataFrame


def retrain_with_pseudo(labelled: DataFrame, rest: DataFrame, columns: Sequence[str], key: str, label: str, makers: Mapping[str, Callable[[str | None], object]], folds: int = 5, limit: float = 0.05, weight: float = 0.5, share: float = 0.8) -> PseudoRetraining:
    """Retraining on labelled rows and on those unlabelled ones on which models agree.

    Models of several families (makers: name to a function of the weight column) predict each unlabelled row as the mean over their folds;
    rows on which the families' deviation is below limit get the mean as label. Features are pruned to those that make up share of the mean
    gain. Each family is trained again on these, with pseudo-labelled rows at weight, and predicts all unlabelled rows; predicted is the mean.
    Rows with equal features (and label) are trained on and predicted once, weighted by their number; a leaf's least rows are counted by weight.
    labelled and rest are read a few times, so they should be durable; predictions are one join of rest with what its different rows get.
    """
    from .splits import fold_mean, k_fold

    raw = F.struct(*columns).alias("__raw")
    known = k_fold(labelled.select(key, F.col(label).alias("label"), raw), key, folds)
    alike = durable(known.groupBy("__raw", "label").agg(*[F.sum((F.col("fold") == k).cast("long")).alias(f"__n{k}") for k in range(folds)]).sortWithinPartitions("__raw", "label"))
    own = rest.select(key, raw)
    others = durable(counted(own, "__raw").sortWithinPartitions("__raw"))
    number = lambda k: sum((F.col(f"__n{j}") for j in range(folds) if j != k), F.lit(0)).cast("double").alias("weight")

    def fitted(make, train: DataFrame):
        return least_by_weight(make("weight"), train.agg(F.sum("weight")).first()[0] or 0).fit(train)

    trains = [durable(assemble(alike.select("__raw.*", "label", number(k)).filter("weight > 0"), columns).select("label", "features", "weight")) for k in range(folds)]
    asked = assemble(others.select("__raw", "__raw.*"), columns).select("__raw", "features")
    votes, gains = [], []
    for name, make in makers.items():
        made = [fitted(make, t) for t in trains]
        tests = predicted(made[0], asked, "p")
        for m in made[1:]:
            tests = tests.unionByName(predicted(m, asked, "p"))
        votes.append(durable(fold_mean(tests, "__raw", "p").withColumn("model", F.lit(name))))
        gains.append(importances(alike.sparkSession, made, columns))
    every = votes[0]
    for v in votes[1:]:
        every = every.unionByName(v)
    agreed = durable(confident(every, "__raw", "p", limit).select("__raw", F.col("p").alias("label")))
    together = gains[0]
    for g in gains[1:]:
        together = together.unionByName(g)
    ranked = cumulative_share(mean_importance(together), share).orderBy(F.desc("gain"), "feature").collect()  # one row a feature
    kept = [r.feature for r in ranked if r.kept] or [ranked[0].feature]
    kept = [c for c in columns if c in set(kept)]
    pseudo = others.join(agreed, "__raw").select("__raw.*", "label", "n")
    train = with_pseudo(*(assemble(d, kept).select("label", "features", "n") for d in (alike.select("__raw.*", "label", number(None).alias("n")), pseudo)), weight)
    train = durable(train.withColumn("weight", F.col("weight") * F.col("n")).drop("n"))
    scored = durable(assemble(others.select("__raw", "__raw.*"), kept).select("__raw", "features"))
    out = _joined([durable(predicted(fitted(make, train), scored, name).select("__raw", name)) for name, make in makers.items()], "__raw")
    out = out.join(agreed.withColumnRenamed("label", "agreed"), "__raw", "left").withColumn("predicted", sum((F.col(n) for n in makers), F.lit(0.0)) / len(makers))
    # the hash goes first: rows are sorted by it fast, and structs are compared within it only
    hashed = lambda d: d.withColumn("__hash", F.xxhash64("__raw"))
    out = hashed(own).join(small(hashed(durable(out))), ["__hash", "__raw"]).drop("__hash", "__raw")
    return PseudoRetraining(kept, out.filter(F.col("agreed").isNotNull()).select(key, F.col("agreed").alias("label")), out)
