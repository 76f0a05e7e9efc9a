"""Document quality by Bradley-Terry ranking.

Labels give preference pairs (a document marked 1 over one marked 0). The chance that a beats b is the logistic function of the difference
of their scores, and a score is linear in features of the whole text; so the weights are a logistic regression, without intercept, on
feature differences. A document is accepted if its score reaches a quantile of the training scores: the share of documents marked 0.
Scores are reported on a logistic scale that puts the threshold at 0.7.

Fitted on all labelled training rows: a document of the smaller class is in PAIRS_EACH pairs on average, so pairs grow with the labels. The
threshold is an order statistic of all training scores. Features come from the text alone.

Defined cases: null text is empty; an empty text gets the score of its (zero) features; without both labels in training no pair exists,
every score is the threshold, and all documents are accepted; unlabelled documents are scored like others; rows
that repeat an id count once in training, and of several labels for an id the smallest counts; an empty table gives no rows; texts are read
whole, of any length; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import exact_percentiles
from . import shared, supervised
from .textcore import SPACE, Words, column_bytes, parts, windows

PAIRS_EACH = 4
FOLD, HELD = 4, 2
THRESHOLD = 0.7
FEATURES = ("log_words", "upper", "marks", "symbols", "bars", "digits", "stops", "mean_word", "long_words", "distinct", "twice", "repeated", "top_word", "short")

_UPPER, _LETTER, _MARK, _SYMBOL, _BAR, _DIGIT, _STOP = range(7)


def _classes() -> np.ndarray:
    out = np.zeros((7, 256), np.float32)
    out[_UPPER, 65:91] = 1
    out[_LETTER, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    out[_MARK, [ord("!"), ord("?")]] = 1
    out[_SYMBOL, [ord(c) for c in "#$%&*@^~<>{}[]=+_\\/"]] = 1
    out[_BAR, ord("|")] = 1
    out[_DIGIT, 48:58] = 1
    out[_STOP, [ord("."), ord(",")]] = 1
    return out


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n_rows = len(off) - 1
    w = Words(data, off, SPACE, True)
    size = np.maximum(np.diff(off), 1).astype(float)
    sums = np.zeros((7, n_rows))
    full = np.flatnonzero(np.diff(off) > 0)
    if len(full):
        for i, table in enumerate(_classes()):
            sums[i, full] = np.add.reduceat(table[data], off[:-1][full])
    n = w.counts.astype(float)
    some = np.maximum(n, 1)
    lens = w.ends - w.starts
    h = w.hashes()
    order = np.lexsort((h, w.rows))
    s, r = h[order], w.rows[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(first)
    runs = np.diff(np.r_[at, len(s)])
    distinct = np.bincount(r[at], minlength=n_rows)
    top = np.zeros(n_rows)
    np.maximum.at(top, r[at], runs)
    twice = np.bincount(w.rows[1:][(h[1:] == h[:-1]) & (w.rows[1:] == w.rows[:-1])], minlength=n_rows)
    g, ga = windows(h, w.rows, 3)
    gr = w.rows[ga]
    order = np.lexsort((g, gr))
    gs, gr = g[order], gr[order]
    again = np.bincount(gr[1:][(gs[1:] == gs[:-1]) & (gr[1:] == gr[:-1])], minlength=n_rows) if len(gs) else np.zeros(n_rows)
    word_sum = np.bincount(w.rows, weights=lens, minlength=n_rows)
    long = np.bincount(w.rows[lens > 18], minlength=n_rows)
    out = np.stack([
        np.log1p(n), sums[_UPPER] / np.maximum(sums[_LETTER], 1), sums[_MARK] / size, sums[_SYMBOL] / size, sums[_BAR] / some, sums[_DIGIT] / size, sums[_STOP] / some,
        word_sum / some / 10, long / some, distinct / some, twice / some, again / some, top / some, (n < 20).astype(float),
    ], axis=1)
    out[:, 2:4] = np.minimum(out[:, 2:4] * 10, 1)
    out[n == 0] = 0
    return out


@dataclass(frozen=True)
class Ranking:
    """Weights of the features, and the score that documents must reach."""

    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; THRESHOLD at the threshold."""
        return supervised.sigmoid(x @ self.weights - self.threshold + np.log(THRESHOLD / (1 - THRESHOLD)))


def _feature_rows(docs: DataFrame) -> DataFrame:
    """x (array<double>) for the text of (id, y, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = column_bytes(batch.column(2))
            for lo, hi in parts(off, 1 << 20):
                x = features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                yield pa.RecordBatch.from_pydict({"id": batch.column(0).slice(lo, hi - lo), "y": batch.column(1).slice(lo, hi - lo), "x": pa.array(list(x), pa.list_(pa.float64()))})

    return docs.select("id", "y", "text").mapInArrow(run, f"id {dict(docs.dtypes)['id']}, y int, x array<double>")


def _training_rows(docs: DataFrame, labels: DataFrame, column: str, key: str, text: str) -> DataFrame:
    """id, y and x of all labelled training documents, once each. Where the labels are too many to broadcast, features travel to them and not texts."""
    known = supervised.labelled(labels, column, FOLD, HELD, key)
    own = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    n = known.count()
    known = shared.by_rows(known, n)
    if supervised.fits(n):
        rows = _feature_rows(own.join(F.broadcast(known), "id"))
    else:
        rows = _feature_rows(own.withColumn("y", F.lit(None).cast("int"))).drop("y").join(known, "id")
    return shared.durable(shared.by_rows(rows.groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")), n))


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", key: str = "doc_id", text: str = "text") -> Ranking:
    shared.tune(docs.sparkSession)
    rows = _training_rows(docs, labels, column, key, text)
    count = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    if not count.get(0) or not count.get(1):
        return Ranking(np.zeros(len(FEATURES)), 0.0)
    # both sides are dealt to slots by hash, and equal slots meet: a document of the smaller class meets PAIRS_EACH of the larger one on average
    slots = max(1, max(count.values()) // PAIRS_EACH)
    slot = lambda y, salt: rows.filter(F.col("y") == y).withColumn("slot", F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(slots)))
    pairs = slot(1, 11).select("slot", F.col("x").alias("a")).join(slot(0, 12).select("slot", F.col("x").alias("b")), "slot")
    ahead = pairs.select(F.zip_with("a", "b", lambda p, q: p - q).alias("d"))
    ahead = shared.durable(shared.by_rows(ahead, count[0] * count[1] // slots))
    if ahead.isEmpty():
        return Ranking(np.zeros(len(FEATURES)), 0.0)
    weights = supervised.fit_differences(ahead, len(FEATURES), 1e-4)
    # the quantile of all training documents: a gap about it is cut in its middle
    value = F.aggregate(F.zip_with("x", F.array(*map(F.lit, weights.tolist())), lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)
    n, at = sum(count.values()), count[0] - 1
    places = {"below": max(at - 1, 0), "above": min(at + 1, n - 1)}
    found = exact_percentiles(rows.select(value.alias("s")), "s", {c: i / max(n - 1, 1) for c, i in places.items()}).first()
    return Ranking(weights, (found.below + found.above) / 2)


def score(docs: DataFrame, model: Ranking, text: str = "text") -> DataFrame:
    """The rows of docs with score (double) and predicted (int)."""
    shared.tune(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = column_bytes(batch.column(at))
            s = [np.zeros(0)]
            for lo, hi in parts(off, 1 << 20):
                s.append(model.score(features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])))
            s = np.concatenate(s)
            yield pa.RecordBatch.from_pydict({c: batch.column(i) for i, c in enumerate(kept)} | {"score": pa.array(s), "predicted": pa.array((s >= THRESHOLD).astype(np.int32))})

    kinds = dict(docs.dtypes)
    return shared.pick(docs, *kept).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", score double, predicted int")


def op3_quality_ranking(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (shared.crc_mod("doc_id", FOLD) == HELD).alias("held_out"), "score", "predicted")


QUERIES = {"op3_quality_ranking": op3_quality_ranking}
ORACLE: dict[str, str] = {}
