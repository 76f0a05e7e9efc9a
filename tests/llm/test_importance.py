"""Importance resampling against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import pyarrow as pa

from prepforge.llm import importance

from .texts import SCHEMA, documents, table

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, n):
    w = ALNUM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, n, buckets, percent, least, seed):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for g in grams(t, n)[1]:
                out[zlib.crc32(g.encode()) % buckets] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, text in docs:
        w, f = grams(text, n)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w)])
    order = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k for k, r in enumerate(order[: percent * len(order) // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in rows), key=str)


def test_features_equal_plain_words():
    texts = [t for _, t in documents()] + ["A B a b c", "Éa\x85b ſ K", None]
    n_words, out = importance.features(pa.array(texts, pa.string()), 3)
    for k, (rows, crc) in enumerate(out, 1):
        have = list(zip(rows.tolist(), crc.tolist(), strict=True))
        want = []
        for i, t in enumerate(texts):
            w, _ = grams(t, 1)
            want += [(i, zlib.crc32(" ".join(w[j : j + k]).encode())) for j in range(len(w) - k + 1)]
            assert n_words[i] == len(w)
        assert have == want


def test_resample(spark, monkeypatch):
    rows = [*documents(), (3, documents()[4][1]), (3, documents()[4][1]), (3, "one more row of an id"), (None, "x " * 30)]
    target = [documents()[4][1], None, "", documents()[7][1], "Ünï w1 w2"]
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    monkeypatch.setattr(importance, "SLICE", 2000)
    for n, buckets, percent, least, seed in ((1, 10_000, 10, 20, 2024), (3, 97, 50, 3, 7)):
        got = importance.resample(table(spark, rows).repartition(3), bench, n, buckets, percent, least, seed)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, target, n, buckets, percent, least, seed)


def test_empty_tables(spark):
    empty, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert importance.resample(empty, bench).count() == 0
    got = importance.resample(table(spark, documents()[:5]), bench).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(documents()[:5], [], 1, 10_000, 10, 20, 2024)
