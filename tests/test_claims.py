"""Claims are learned from counted rows: equal rows once, with their number, and the same scores."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from prepforge.operators import models as mo
from prepforge.operators import splits as sp
from prepforge.operators.encode import ClaimEngineer
from prepforge.plans import flows


def test_equal_rows_are_met_once(spark, monkeypatch):
    mod = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m))
    a = F.when(mod(1, 4) > 0, mod(1, 4).cast("double"))
    df = spark.range(3000).select("id", a.alias("a"), mod(2, 5).cast("double").alias("b"), F.when(mod(3, 3) > 0, F.concat(F.lit("k"), mod(3, 3))).alias("c"), ((mod(2, 5) + mod(4, 6)) > 6).cast("int").alias("label"))
    seen = []
    fit = mo.logistic_meta
    monkeypatch.setattr(mo, "logistic_meta", lambda x, *rest, **kw: seen.append(x.count()) or fit(x, *rest, **kw))
    got = {r.id: r for r in flows.claim_flow(df, "id", "label", "c", ["a", "b"], folds=3, rounds=2).collect()}
    assert len(got) == 3000 and len(seen) == 3 and max(seen) <= 4 * 5 * 3 * 2
    known = {r.id: r.b for r in df.collect()}
    mean = lambda v: sum(r.a for i, r in got.items() if known[i] == v) / max(1, sum(x == v for x in known.values()))
    assert mean(4) > mean(0) + 0.2
    # the linear model of fold 0, fitted on each row by itself
    rows = sp.stratified_k_fold(df, "id", "label", 3)
    train, held = rows.filter("fold <> 0"), rows.filter("fold = 0")
    eng = ClaimEngineer(train, "c", products=[("a", "b")], ratios=[("a", "b")], flags=["a"])
    names = ["a", "b", "eng_a_x_b", "eng_a_div_b", "eng_a_is_missing", "c_freq"]
    plain = mo.probability(fit(eng.transform(train), names, "label"), mo.assemble(eng.transform(held), names), "p").collect()
    assert len(plain) > 900 and max(abs(got[r.id].b - r.p) for r in plain) < 1e-3
    # final is the mean of the average-tie ranks of all rows
    for c in ("a", "b"):
        s = sorted(got.values(), key=lambda r: r[c])
        first, last = {}, {}
        for i, r in enumerate(s, 1):
            first.setdefault(r[c], i)
            last[r[c]] = i
        ranks = {r.id: (first[r[c]] + last[r[c]]) / 2 / 3000 for r in s}
        total = {k: total[k] + v for k, v in ranks.items()} if c == "b" else ranks
    assert all(r.final == pytest.approx(total[k] / 2, abs=1e-9) for k, r in got.items())
