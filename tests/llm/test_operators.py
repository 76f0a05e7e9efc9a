"""Each operator against a brute-force version, on small tables with the hard cases, and on empty tables."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from prepforge.llm import ann, brown, decontam, neardup, pairmerge, quality, repair, substring, toxicity, urllists, wordbpe

from .texts import SCHEMA, documents, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, documents()).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1 -----------------------------------------------------------------------------------------------------------------------------------


def test_brown_base_and_order(spark, docs, empty):
    rows = {r.doc_id: r for r in brown.BrownModel(docs).score().collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in documents()}
    c = Counter(w for i, ws in tokens.items() if i is not None and not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(tokens)
    for i, ws in tokens.items():
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, held(i))
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.score < 0 and r.perplexity > 1
    assert sum(r.score for r in rows.values()) > sum(r.base_score for r in rows.values())
    assert brown.BrownModel(empty).score().count() == 0


def test_brown_scores_equal_plain_python(spark, docs, monkeypatch):
    """Classes of outer words by whole likelihoods, sums of probabilities, and scores word by word, given the classes of the core and the transitions."""
    import numpy as np

    from prepforge.llm.textcore import SPACE, Words

    monkeypatch.setattr(brown, "CORE", 60)
    model = brown.BrownModel(docs)
    got = {r.doc_id: r.score for r in model.score().collect()}
    end, unseen = brown.END_CLASS, brown.UNSEEN
    tokens = {i: WORD.findall(lower(t)) for i, t in documents()}
    train = {i: ws for i, ws in tokens.items() if i is not None and zlib.crc32(str(i).encode()) % 7 != 2}
    c = Counter(w for ws in train.values() for w in ws)

    def hashed(w):
        raw = np.frombuffer(w.encode(), np.uint8)
        return int(Words(raw, np.array([0, len(raw)]), SPACE, True).hashes()[0])

    core = {int(h): n for n, h in enumerate(model.core)}
    at = {w: core.get(hashed(w), -1) for w in {w for ws in tokens.values() for w in ws}}
    assert sorted(-n for n in c.values())[: len(core)] == sorted(-c[w] for w in c if at[w] >= 0)

    def likelihood(pairs):
        x = lambda v: v * math.log(v) if v > 0 else 0.0
        return sum(x(v) for v in pairs.ravel()) - sum(x(v) for v in pairs.sum(0)) - sum(x(v) for v in pairs.sum(1))

    kind = {}
    for w in c:
        if at[w] >= 0:
            kind[w] = int(model.fine[at[w]])
            continue
        right, left = np.zeros(brown.COARSE), np.zeros(brown.COARSE)
        for ws in train.values():
            for a, b in zip(ws[:-1], ws[1:], strict=True):
                if a == w and at[b] >= 0:
                    right[model.coarse[at[b]]] += 1
                if b == w and at[a] >= 0:
                    left[model.coarse[at[a]]] += 1
        gains = []
        for g in range(brown.COARSE):
            pairs = model.coarse_pairs.copy()
            pairs[g] += right
            pairs[:, g] += left
            gains.append(round(likelihood(pairs), 6))
        side = gains.index(max(gains)) if right.sum() + left.sum() else brown.COARSE
        kind[w] = brown.CLASSES + side * brown.BANDS + min(int(math.log2(c[w])), brown.BANDS - 1)
    p = 10**model.model.transitions
    assert np.allclose(p.sum(1), 1)
    sizes = Counter()
    for w, k in kind.items():
        sizes[k] += c[w]
    for k, size in sizes.items():
        assert model.model.class_tokens[k] == size
        assert sum(c[w] / size for w in kind if kind[w] == k) == pytest.approx(1)
    for i, ws in tokens.items():
        kinds = [end, *[kind.get(w, unseen) for w in ws], end]
        want = sum(math.log10(p[a, b]) for a, b in zip(kinds[:-1], kinds[1:], strict=True)) + sum(math.log10(c[w] / sizes[kind[w]]) for w in ws if w in kind)
        assert got[i] == pytest.approx(want, rel=1e-9, abs=1e-9), i


def test_exchange_separates_alternating_words():
    import numpy as np

    rng = np.random.default_rng(0)
    n = np.zeros((8, 8))
    for _ in range(4000):  # even words follow odd words and the other way round
        a, b = 2 * rng.integers(4), 2 * rng.integers(4) + 1
        n[a, b] += 1
        n[b, a] += 1
    g = brown.exchange(n[np.ix_([0, 1, 4, 3, 2, 5, 6, 7], [0, 1, 4, 3, 2, 5, 6, 7])], 2)
    even = {g[i] for i in (0, 2, 4, 6)}
    odd = {g[i] for i in (1, 3, 5, 7)}
    assert len(even) == len(odd) == 1 and even != odd


# --- 2 -----------------------------------------------------------------------------------------------------------------------------------


def test_url_lists_follow_the_list_of_the_day(spark):
    caps = spark.createDataFrame(
        [(1, "http://a.b.example.org/x/?q=1#t", "2024-01-05"), (2, "https://A.b.example.org/x", "2024-01-15"), (3, "http://a.b.example.org/x", "2024-02-15"), (4, "http://z.example.org/", "2024-01-05"), (5, None, "2024-01-05"), (6, "no address", "2024-01-05"), (7, "http://z.example.org/", None), (8, "http://z.example.org/", "2024-01-01"), (1, "http://z.example.org/", "2023-12-31")],
        "id long, url string, fetched_at string",
    ).withColumn("fetched_at", F.to_timestamp("fetched_at")).withColumn("salt", F.lit(1)).withColumn("rank", F.lit(2))
    entries = spark.createDataFrame(
        [("domain", "example.org", "block", "2024-01-01"), ("host", "a.b.example.org", "allow", "2024-01-10"), ("host", "a.b.example.org", "remove", "2024-02-01"), ("address", "a.b.example.org/x", "block", "2024-01-15"), ("address", "a.b.example.org/x", "remove", "2024-01-15"), ("host", None, "block", "2024-01-01"), ("host", "z", "unknown", "2024-01-01"), ("planet", "example.org", "block", "2024-01-01")],
        "kind string, pattern string, action string, at string",
    ).withColumn("at", F.to_timestamp("at")).withColumn("id", F.lit("x"))
    out = {(r.id, str(r.fetched_at)[:10]): (r.blocked, r.kind, r.n_active) for r in urllists.filter_captures(caps, entries).collect()}
    assert out[(1, "2024-01-05")] == (True, "domain", 1)
    assert out[(2, "2024-01-15")] == (False, "host", 2)
    assert out[(3, "2024-02-15")] == (True, "domain", 1)
    assert out[(4, "2024-01-05")] == out[(8, "2024-01-01")] == (True, "domain", 1)
    assert out[(5, "2024-01-05")] == out[(6, "2024-01-05")] == out[(7, "None")] == out[(1, "2023-12-31")] == (False, None, 0)
    iv = {(r.pattern, str(r.valid_from)[:10], str(r.valid_to)[:10]) for r in urllists.intervals(entries).collect()}
    assert iv == {("example.org", "2024-01-01", "None"), ("a.b.example.org", "2024-01-10", "2024-02-01")}
    assert urllists.filter_captures(caps, entries.limit(0)).filter("blocked").count() == 0
    assert urllists.filter_captures(caps.limit(0), entries).count() == 0


def test_deep_hosts_and_hot_keys(spark, monkeypatch):
    host = "a.b.c.d.e.f.g.example.org"
    rows = [(i, f"http://{host}/p{i % 7}", f"2024-01-{1 + i % 28:02d}") for i in range(6000)]
    caps = spark.createDataFrame(rows, "id long, url string, fetched_at string").withColumn("fetched_at", F.to_timestamp("fetched_at"))
    entries = spark.createDataFrame(
        [("domain", "d.e.f.g.example.org", "block", "2024-01-05"), ("domain", host, "allow", "2024-01-10"), ("domain", host, "remove", "2024-01-20"), ("address", f"{host}/p3", "block", "2024-01-15")],
        "kind string, pattern string, action string, at string",
    ).withColumn("at", F.to_timestamp("at"))
    got = {(r.id, r.blocked, r.kind, r.pattern, r.n_active) for r in urllists.filter_captures(caps, entries).collect()}
    want = set()
    for i, url, at in rows:  # 6,000 look-ups of one key: more than a salt's share
        day, found = int(at[-2:]), []
        if day >= 15 and url.endswith("/p3"):
            found.append((3, "address", f"{host}/p3", True))
        if 10 <= day < 20:
            found.append((2, "domain", host, False))
        if day >= 5:
            found.append((1, "domain", "d.e.f.g.example.org", True))
        best = max(found, default=(0, None, None, False))
        want.add((i, best[3], best[1], best[2], len(found)))
    assert got == want


# --- 3, 10 -------------------------------------------------------------------------------------------------------------------------------


def _marked(spark, bad, good, n=240):
    rows = [(i, (bad if i % 4 == 0 else good)(i)) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(n)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    return table(spark, [*rows, (9000, None), (9001, "")]), labels


def test_quality_separates_and_handles_missing_labels(spark, empty):
    docs, labels = _marked(spark, lambda i: f"SPAM{i}!! " * 30, lambda i: " ".join(f"word{(i * j) % 97} of" for j in range(40)) + ".")
    model = quality.fit(docs, labels)
    out = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(out) == 242 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(out[i].predicted == int(i % 4 != 0) for i in held) / len(held) > 0.95
    alone = quality.fit(docs, labels.filter("quality = 1"))
    assert {r.predicted for r in quality.score(docs, alone).collect()} == {1}
    assert quality.score(empty, model).count() == 0 and quality.fit(empty, labels).threshold == 0


def test_toxicity_learns_from_training_rows_only(spark, empty):
    docs, labels = _marked(spark, lambda i: " ".join(f"word{(i * j) % 97}" for j in range(30)) + " you rotter " + f"end{i}", lambda i: " ".join(f"word{(i * j) % 97}" for j in range(40)))
    model = toxicity.fit(docs, labels)
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out[i].predicted == int(i % 4 == 0) for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values()) and out[9000].score == out[9001].score
    turned = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, turned)
    assert (again.places == model.places).all() and abs(again.weights - model.weights).max() < 1e-6
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert {round(r.score, 6) for r in toxicity.score(docs, none).collect()} == {0.0}


# --- 4 -----------------------------------------------------------------------------------------------------------------------------------


def _removed(rows, k):
    own = {(n, i): WORD.findall(t or "") for n, (i, t) in enumerate(rows)}
    least: dict = {}
    for (_, i), ws in own.items():
        if i is not None:
            for a in range(len(ws) - k + 1):
                key = tuple(ws[a : a + k])
                least[key] = min(least.get(key, i), i)
    out = []
    for (_, i), ws in own.items():
        gone = set()
        for a in range(len(ws) - k + 1):
            if i is not None and least[tuple(ws[a : a + k])] < i:
                gone |= set(range(a, a + k))
        out.append((i, len(ws), len(gone), " ".join(w for n, w in enumerate(ws) if n not in gone)))
    return out


@pytest.mark.parametrize("window", [13, 4])
def test_substrings(spark, empty, window):
    rows = documents() + [(7, "again " * 40), (7, "again " * 40 + "tail")]
    got = substring.dedup_substrings(table(spark, rows), window=window, keep=["lang"])
    found = Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect())
    assert found == Counter(_removed(rows, window))
    assert sum(r[2] for r in found) > 0
    for r in got.filter("n_removed > 0").collect():
        assert sum(r.removed[1::2]) - sum(r.removed[::2]) == r.n_removed and r.lang == "en"
    assert substring.dedup_substrings(empty).count() == 0


# --- 5 -----------------------------------------------------------------------------------------------------------------------------------


def test_token_files_round_trip(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = wordbpe.tokenizer_file("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    repair.write_tokens(docs, str(tmp_path / "t"), path, shard_tokens=20_000)
    got = repair._crc(repair.read_tokens(spark, str(tmp_path / "t"))).join(repair.shard_starts(spark, str(tmp_path / "t")), ["part", "shard"]).collect()
    want, at = [], 0
    for i, t in sorted(documents(), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), ids))
        at += len(ids)
    have = sorted(((r.doc_id, r.begin + r.local, r.n_tokens, list(memoryview(bytes(r.ids)).cast("I"))) for r in got), key=lambda r: r[1])
    assert have == want
    for r in got[:3]:
        row = sum(1 for x in got if (x.part, x.shard) == (r.part, r.shard) and x.local < r.local)
        assert repair.read_document(spark, str(tmp_path / "t"), r.part, r.shard, row) == list(memoryview(bytes(r.ids)).cast("I"))
    repair.write_tokens(empty, str(tmp_path / "e"), path)
    assert repair.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_ids_beyond_a_megabyte_of_new_stretches():
    import numpy as np
    from tokenizers import Tokenizer

    path = wordbpe.tokenizer_file("byte_bpe_50k.json")
    library, rules = Tokenizer.from_file(path), pairmerge.PairMerges(json.loads(open(path).read())["model"])
    for token in ("aaa", "aaaaaaa", "ababab", "eeee"):
        for shift in range(12):
            filler = [b"x"] * ((1 << 20) - shift)
            tokens = [*filler, token.encode(), b"zzz"]
            ids, n = rules.ids(np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens]))
            end = int(n[:-1].sum())
            assert ids[end - int(n[-2]) : end].tolist() == library.encode(token, add_special_tokens=False).ids


def test_long_texts_and_forgotten_stretches_equal_the_library(monkeypatch):
    import numpy as np
    from tokenizers import Tokenizer

    path = wordbpe.tokenizer_file("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), repair.ByteBpe(open(path).read())

    def same(texts):
        raw = [t.encode() for t in texts]
        ids, n = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert n.tolist() == [len(x) + 1 for x in want]
        assert ids.tolist() == [i for x in want for i in [*x, 0]]

    rng = random.Random(3)
    words = ["".join(rng.choice("aabbee") for _ in range(rng.randrange(1, 14))) + str(i) for i in range(230_000)]
    same([" ".join(words)])  # 3 MB of new stretches in one call
    monkeypatch.setattr(repair, "MEMORY_WORDS", 1000)
    for lo in range(0, 3000, 500):
        same([" ".join(words[lo : lo + 500]), " ".join(words[:40])])
    assert len(own.known) <= 3000


def test_grammar_is_exact_and_smaller():
    import numpy as np

    rng = np.random.default_rng(3)
    ids = np.r_[np.tile(rng.integers(1, 50, 40), 100), rng.integers(0, 50, 500), np.full(300, 9), np.zeros(3, int)].astype(np.uint16)
    s, rules, lengths = repair.compress(ids, 100)
    assert (repair.expand(s, repair.expansions(rules, lengths, 100)) == ids).all() and len(s) < len(ids) / 3
    s, rules, lengths = repair.compress(ids[:1], 100)
    assert s.tolist() == ids[:1].tolist() and not len(rules)


# --- 6 -----------------------------------------------------------------------------------------------------------------------------------


def test_hilbert_steps_are_one_cell():
    import numpy as np

    for dims, bits in ((2, 3), (3, 2), (5, 1)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = ann.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def _recall(spark, x, **options):
    import numpy as np

    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 50 = 0", **options).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = n = 0
    for q in range(0, len(x), 50):
        s = u[q] @ u.T
        s[q] = -9
        have = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in have] == [1, 2, 3, 4, 5] and all(abs(r.score - s[r.vec_id]) < 1e-12 for r in have)
        assert [r.vec_id for r in have] == sorted((r.vec_id for r in have), key=lambda i: (-round(s[i], 13), i))
        hits, n = hits + len({r.vec_id for r in have} & set(np.argsort(-s, kind="stable")[:5].tolist())), n + 5
    return hits / n


def test_nearest_recall(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    flat = rng.standard_normal((6000, 64))
    assert 2 * ann.SHARE * ann.PROBES < 0.65  # a query is compared with 0.64 N vectors
    assert _recall(spark, flat) >= 0.9
    clustered = rng.standard_normal((300, 64))[rng.integers(0, 300, 6000)] + 0.3 * rng.standard_normal((6000, 64))
    assert _recall(spark, clustered, share=0.004) >= 0.9
    assert _recall(spark, flat[:1500], orderings=1, probes=1, share=1) == 1  # the exact search


def test_nearest(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 12))
    x[10] = x[9] = x[0] + 0.01  # a tie
    rows = [(int(i), v.tolist(), 1, 2, 3, b"") for i, v in enumerate(x)]
    bad = [(400, None), (450, [0.0] * 12), (402, [float("nan")] + [1.0] * 11), (403, [None] + [1.0] * 11), (404, [1.0] * 3), (405, [float("inf")] * 12), (None, [1.0] * 12), (406, [])]
    rows += [(*r, 1, 2, 3, b"") for r in [*bad, (7, x[7].tolist()), (9, (-x[0]).tolist())]]  # 7 and 9 repeat ids
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, t int, id long, pos long, vec binary")
    got = ann.nearest(df, "id % 50 = 0").collect()
    assert len(got) == 40 and len({(r.query_id, r.vec_id) for r in got}) == 40 and {r.vec_id for r in got} <= set(range(400))
    assert [(r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0][:2] == [9, 10]
    few = ann.nearest(df.filter("vec_id in (0, 3)"), "id % 50 = 0").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(0, 1, 3)]
    assert ann.nearest(df.limit(0), "id % 50 = 0").count() == 0 and ann.nearest(df.filter("vec_id = 450"), "id % 50 = 0").count() == 0


# --- 7 -----------------------------------------------------------------------------------------------------------------------------------


def _components(rows, k=5, percent=75):
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    ids = [i for i, _ in rows]
    least = list(ids)
    changed = True
    links = [(a, b) for a in range(len(rows)) for b in range(a) if ids[a] is not None and ids[b] is not None and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return sorted(((i, len(s), m, i is None or m == i) for i, s, m in zip(ids, sets, least, strict=True)), key=str)


def test_near_duplicates(spark, docs, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect()), key=str)
    assert got == _components(documents())
    assert sum(not r[3] for r in got) > 10
    assert neardup.near_duplicates(empty).count() == 0
    assert neardup.near_duplicates(docs.filter("doc_id > 999 and doc_id < 1003")).filter("kept").count() == 3


def test_large_groups_of_near_copies(spark):
    import random

    rng = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 9)):
            w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(base[:9] + [f"y{i}_{j}" for j in range(60)])) for i in range(150, 220)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(table(spark, rows)).collect()), key=str)
    assert got == _components(rows)


def test_roots_are_relabelled_when_components_merge(spark):
    import random

    def changed(words, places, tag):
        return [f"{tag}{i}" if i in places else w for i, w in enumerate(words)]

    # a V: 100 is linked with 50 (nearer) and with 3, which are not linked with each other
    base = [f"v{i}" for i in range(300)]
    rows = [(100, " ".join(base)), (50, " ".join(changed(base, (40, 80), "p"))), (3, " ".join(changed(base, range(150, 294, 18), "q")))]
    rows += [(60, rows[1][1])]  # an exact copy of the root
    # a chain in which only neighbours are linked, with shuffled ids
    ids = list(range(200, 224))
    random.Random(7).shuffle(ids)
    words = [f"c{i}" for i in range(300)]
    for n, i in enumerate(ids):
        words = changed(words, {(n * 71 + 29 * j) % 300 for j in range(6)}, f"s{n}_")
        rows.append((i, " ".join(words)))
    want = _components(rows)
    assert {r[2] for r in want} == {3, 200}
    assert all(r[2] == 50 for r in _components([r for r in rows if r[0] in (3, 50)]) if r[0] == 50)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(table(spark, rows)).collect()), key=str)
    assert got == want


def _changed_words(rng, words, n, tag, places):
    at = set(rng.sample(places, n))
    return " ".join(f"{tag}_{i}" if i in at else w for i, w in enumerate(words))


def test_links_ranked_behind_failed_partners(spark):
    import random

    rng = random.Random(11)
    rows, want = [], []
    for f in range(3):  # two linked texts, and 140 below the threshold of which many look nearer to both
        base = [f"f{f}_{i}" for i in range(1200)]
        places = list(range(2, 1196, 6))
        rng.shuffle(places)
        family = [(1000 * f + 140 + i, _changed_words(rng, base, 17, f"y{f}_{i}", places[17 * i : 17 * i + 17])) for i in range(2)]
        family += [(1000 * f + i, _changed_words(rng, base, 24, f"z{f}_{i}", places[34:])) for i in range(140)]
        assert [r[0] for r in _components(family) if not r[3]] == [1000 * f + 141]
        rows, want = rows + family, want + _components(family)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(table(spark, rows)).collect()), key=str)
    assert got == sorted(want, key=str)


def test_pairs_within_a_large_node_of_boilerplate(spark, monkeypatch):
    import random

    monkeypatch.setattr(neardup, "LEAF", 16)
    monkeypatch.setattr(neardup, "WEIGHT", 1 << 14)
    rng = random.Random(5)
    rows = []
    for i in range(75):  # all texts share a licence, and each is linked with one other
        words = [f"licence{j}" for j in range(240)] + [f"own{i}_{j}" for j in range(45)]
        rows += [(i, " ".join(words)), (500 + i, _changed_words(rng, words, 4, f"z{i}", range(2, 276, 6)))]
    want = _components(rows)
    assert sum(not r[3] for r in want) == 75
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(table(spark, rows)).collect()), key=str)
    assert got == want


def test_recall_among_boilerplate(spark):
    """8,000 texts that share 300 words (0.68 similar), each linked with one other at 0.76 to 0.8: all links are found."""
    rng = random.Random(2)
    rows = []
    for i in range(4000):
        words = [f"licence{j}" for j in range(300)] + [f"own{i}_{j}" for j in range(70)]
        at = set(rng.sample(range(370), 10))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(f"z{i}_{j}" if j in at else w for j, w in enumerate(words)))]
    rng.shuffle(rows)
    texts = dict(rows)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [i for i in range(4000) if not _components([(2 * i, texts[2 * i]), (2 * i + 1, texts[2 * i + 1])])[1][3]]
    assert len(linked) > 3900 and sum(got[2 * i + 1] == 2 * i for i in linked) >= 0.99 * len(linked)
    assert all(a // 2 == b // 2 for a, b in got.items())


def test_nodes_branch_until_small(spark, monkeypatch):
    import random

    monkeypatch.setattr(neardup, "LEAF", 4)
    rng = random.Random(6)
    rows = []
    for f in range(12):  # families that share a passage with all others, so that roots are large and separable
        base = [f"common{j}" for j in range(60)] + [f"f{f}_{j}" for j in range(140)]
        rows += [(100 * f + i, _changed_words(rng, base, 3, f"z{f}_{i}", range(62, 196, 6))) for i in range(10)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(table(spark, rows)).collect()), key=str)
    assert got == _components(rows)


def test_common_tokens_equal_set_intersections():
    import numpy as np

    rng = np.random.default_rng(3)
    unit = np.sort(rng.integers(0, 5, 90))
    right = (rng.random(90) < 0.5) & (unit % 2 == 0)
    sets = [np.unique(rng.integers(0, 60 if u < 3 else 4000, rng.integers(0, 50))) for u in unit]
    tokens, rows = np.concatenate(sets).astype(np.uint64), np.repeat(np.arange(90), [len(x) for x in sets])
    i, j, n = neardup.common_tokens(tokens, rows, unit, right)
    want = {(a, b): c for a in range(90) for b in range(90) if unit[a] == unit[b] and ((not right[a] and right[b]) if unit[a] % 2 == 0 else a < b) and (c := len(np.intersect1d(sets[a], sets[b])))}
    assert dict(zip(zip(i.tolist(), j.tolist(), strict=True), n.tolist(), strict=True)) == want


def test_several_texts_under_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c), (None, a)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(table(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (4, 4, True), (4, 4, True), (None, None, True)], key=str)


def test_links_of_several_texts_under_one_id(spark):
    def near(x):
        w = [f"{x}{i}" for i in range(60)]
        return " ".join(w), " ".join([*w[:-1], f"{x}changed"])

    (a, a2), (b, b2), (c, c2) = near("a"), near("b"), near("c")
    rows = [(3, a), (5, a2), (5, b), (7, b2), (5, c), (9, c2), (8, c2), (5, "one more")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(table(spark, rows)).collect()), key=str)
    assert got == _components(rows)
    assert sorted((i, c) for i, _, c, _ in got) == [(3, 3), (5, 3), (5, 5), (5, 5), (5, 5), (7, 5), (8, 5), (9, 5)]


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 90), (100, 95)], "a long, b long")
    got = {r.node: r.label for r in neardup.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[95] == got[100] == 90
    ids = [7 * i % 101 for i in range(101)]
    zigzag = [(max(a, b), min(a, b)) for a, b in zip(ids[:-1], ids[1:], strict=True)]
    assert {r.label for r in neardup.components(spark.createDataFrame(zigzag, "a long, b long")).collect()} == {0}


# --- 8 -----------------------------------------------------------------------------------------------------------------------------------


def test_decontamination(spark, docs, empty):
    own = documents()
    alnum = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    items = [(1, own[3][1]), (2, "Only, THREE words!"), (10, own[9][1][:200]), (11, None), (12, "--"), (13, own[3][1])]
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, terms int")
    for blocks in (40_000, 7):
        got = {(r.doc_id, r.n_words): r for r in decontam.decontaminate(docs, bench, block_windows=blocks).collect()}
        assert len(got) == len(own)
        for i, t in own:
            w = alnum.findall(lower(t))
            hit, names = set(), set()
            for n, text in items:
                b = alnum.findall(lower(text))
                k = min(10, len(b))
                for win in {tuple(b[a : a + k]) for a in range(len(b) - k + 1)} if k else ():
                    for a in range(len(w) - k + 1):
                        if tuple(w[a : a + k]) == win:
                            hit |= set(range(a, a + k))
                            names.add(str(n))
            r = got[(i, len(w))]
            assert (r.n_hit, r.n_items, r["items"]) == (len(hit), len(names), sorted(names)), i
            assert sum(r.ends) - sum(r.begins) == len(hit)
    assert decontam.decontaminate(empty, bench).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_proximity(spark):
    d = table(spark, [(1, "alpha x beta y gamma"), (2, "gamma alpha beta"), (3, "alpha a b c d e f g beta gamma"), (4, "alpha beta")])
    b = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    hits = lambda p: {r.doc_id for r in decontam.decontaminate(d, b, proximity=p).filter("n_hit > 0").collect()}
    assert hits(0) == {2} and hits(2) == {1, 2} and hits(7) == {1, 2, 3}


# --- 9 -----------------------------------------------------------------------------------------------------------------------------------


def test_word_bpe_equals_the_library(spark, docs, empty):
    from tokenizers import Tokenizer

    path = wordbpe.tokenizer_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = {(r.doc_id, r.text): r for r in wordbpe.encode_decode(docs, path).collect()}
    for i, t in documents():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        r = got[(i, t)]
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), " ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False))
    assert wordbpe.encode_decode(empty, path).count() == 0


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(wordbpe, "MEMORY_WORDS", 10)
    with open(wordbpe.tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        bpe = wordbpe.WordBpe(f.read())
    texts = [f"some words number{i} and number{i % 3}" for i in range(40)]
    for t in texts:
        n, ids, back = bpe.run([t.encode()])
        want = bpe.library.encode(t, add_special_tokens=False).ids
        assert (n[0], ids[0]) == (len(want), " ".join(map(str, want))) and back[0]


def test_digests(spark, docs):
    out = wordbpe.digests(wordbpe.encode_decode(docs.select("doc_id", "text"), wordbpe.tokenizer_file("word_bpe_49k.json"))).filter("doc_id = 1001").first()
    assert out.ids_sha256 == out.decoded_sha256 == hashlib.sha256(b"").hexdigest()


# --- pipeline ----------------------------------------------------------------------------------------------------------------------------


def _pipeline_left(rows, benchmark):
    """Row numbers and texts left of accepted rows by plain Python: near-duplicates, substrings, benchmark windows."""
    kept = [(i, t) for (i, t), verdict in zip(rows, _verdicts(rows), strict=True) if verdict]
    left = [(i, text) for i, _, _, text in _removed(kept, 13)]
    alnum = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    clean = []
    for i, t in left:
        w = alnum.findall(lower(t))
        hit = False
        for item in benchmark:
            b = alnum.findall(lower(item or ""))
            size = min(10, len(b))
            grams = {tuple(b[a : a + size]) for a in range(len(b) - size + 1)} if size else set()
            hit = hit or any(tuple(w[a : a + size]) in grams for a in range(len(w) - size + 1))
        if not hit:
            clean.append((i, t))
    return clean


def _verdicts(rows):
    """Whether each row stays: a row is judged by its own text, against every row."""
    known = [r for r in rows if r[0] is not None]
    w = {t: WORD.findall(lower(t)) for _, t in known}
    sets = {t: {tuple(x[i : i + 5]) for i in range(max(len(x) - 4, 1))} if x else set() for t, x in w.items()}
    least = {t: min(i for i, u in known if u == t) for t in sets}
    near = [(t, u) for t in sets for u in sets if t is not u and sets[t] and sets[u] and 100 * len(sets[t] & sets[u]) >= 75 * len(sets[t] | sets[u])]
    for _ in sets:
        for t, u in near:
            least[t] = min(least[t], least[u])
    return [i is None or not sets[t] or least[t] == i for i, t in rows]


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline as cp

    rng = random.Random(8)
    rows = [(i, t) for i, t in documents() if i is not None] + [(3000, " ".join(f"r{j}" for j in range(30)))] * 2  # a repeated row
    junk = [(2000 + i, " ".join("".join(rng.choice("#$%&*@{}") for _ in range(9)) + "!!" for _ in range(40 + i))) for i in range(30)]
    rows += [*junk, (None, documents()[4][1]), (None, "a row without id that is clean"), (None, None)]
    bench = [documents()[4][1], None, "   "]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))  # with extra columns of helpers' names
    labels = [(i, int(i < 2000), 0, "x") for i, _ in rows if i is not None and i % 2] + [(2001, 1, 0, "x"), (None, 0, 0, "x"), (77777, 0, 0, "x"), (5, None, 0, "x")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, score string").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256) for r in cp.run(spark, str(tmp_path)).collect()), key=str)
    accepted = cp.quality_filter(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert accepted.columns == list(cp.COLUMNS)
    accepted = [(r.doc_id, r.text) for r in accepted.collect()]
    assert not set(accepted) & set(junk)
    assert len(accepted) >= len(rows) - len(junk) - 12
    tok = Tokenizer.from_file(wordbpe.tokenizer_file("word_bpe_49k.json"))
    want = []
    for i, t in _pipeline_left(accepted, bench):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    assert got == sorted(want, key=str) and len(want) < len(accepted)
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "substrings", "decontamination", "bpe"]


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    table(spark, documents()).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


# --- 3 and 10 against plain versions -----------------------------------------------------------------------------------------------------


def test_ranking_equals_a_dense_fit(spark):
    """Bradley-Terry weights against Newton's method on the same pairs, and the threshold against the quantile of the sample."""
    import numpy as np

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["word", "other", "SHOUT!!", "a.", "12", "word word"]) for _ in range(rng.randrange(5, 60)))) for i in range(160)]
    labels = spark.createDataFrame([(i, int(rng.random() < (0.8 if t.count("!") * 6 < len(t.split()) else 0.3))) for i, t in rows], "doc_id long, quality int")
    docs = table(spark, rows)
    model = quality.fit(docs, labels)
    own = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    text = dict(rows)
    raw = {i: text[i].encode() for i in own}
    x = {i: quality.features(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0] for i, b in raw.items()}
    n = [sum(y == k for y in own.values()) for k in (0, 1)]
    slots = max(1, max(n) // quality.PAIRS_EACH)
    slot = {r.id: (r.a, r.b) for r in spark.createDataFrame([(i,) for i in own], "id long").select("id", *[F.pmod(F.xxhash64("id", F.lit(s)), F.lit(slots)).alias(c) for s, c in ((11, "a"), (12, "b"))]).collect()}
    d = np.array([x[i] - x[j] for i in own if own[i] == 1 for j in own if own[j] == 0 and slot[i][0] == slot[j][1]])
    w = np.zeros(d.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-d @ w))
        w -= np.linalg.solve((d.T * (p * (1 - p))) @ d / len(d) + 1e-4 * np.eye(len(w)), -d.T @ (1 - p) / len(d) + 1e-4 * w)
    loss = lambda v: np.log1p(np.exp(-d @ v)).mean() + 0.5e-4 * v @ v
    assert len(d) > 100 and loss(model.weights) <= loss(w) * 1.001
    order = np.array([v for v in x.values()]) @ w
    mine = np.array([v for v in x.values()]) @ model.weights
    assert np.corrcoef(order, mine)[0, 1] > 0.999
    s = sorted(mine)
    at = n[0]
    assert s[max(at - 2, 0)] <= model.threshold <= s[min(at + 2, len(s) - 1)]
    # several labels for an id count as the smallest, and repeated rows as one
    again = quality.fit(docs.unionByName(docs), labels.unionByName(labels).unionByName(labels.filter("doc_id < 20").withColumn("quality", F.lit(1))))
    assert abs(again.weights - model.weights).max() < 1e-9 and again.threshold == pytest.approx(model.threshold)


def test_ratios_and_scores_equal_a_dictionary_version(spark):
    import numpy as np

    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["You", "rotter", "fine  day", "ÄÖ", "x\ty", "good"][: 2 + 4 * (i % 3 > 0)]) for _ in range(rng.randrange(1, 25)))) for i in range(90)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    docs = table(spark, rows)

    def grams(t):
        b = bytes(0x20 if c in b" \t\n\x0b\x0c\r" else c + 32 if 0x41 <= c <= 0x5A else c for c in t.encode())
        return {b[i : i + n] for n in toxicity.ORDERS for i in range(len(b) - n + 1)}

    def place(g):
        raw = np.frombuffer(g, np.uint8)
        return next(int(h[0]) for n, (h, _) in zip(toxicity.ORDERS, (x for x in toxicity.ngrams(raw, np.array([0, len(raw)]))), strict=False) if n == len(g))

    train = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 0]
    held = {p: {place(g) for g in grams(t)} for p, (_, t) in enumerate(rows)}
    count = [Counter(), Counter()]
    for p, (i, _) in enumerate(rows):
        if zlib.crc32(str(i).encode()) % 5 != 0:
            count[int(i % 3 == 0)].update(held[p])
    own = spark.createDataFrame([(i, int(i % 3 == 0), t) for i, t in train], "id long, y int, text string")
    got = {r.place: (r.p, r.q) for r in toxicity._counts(own).collect()}
    assert got == {g: (count[1][g], count[0][g]) for g in {*count[0], *count[1]} if count[1][g] + count[0][g] >= 4}
    model = toxicity.fit(docs, labels)
    n1, n0 = (sum(i % 3 == 0 for i, _ in train), sum(i % 3 > 0 for i, _ in train))
    ratio = {g: math.log((p + 1) / (n1 + 2)) - math.log((q + 1) / (n0 + 2)) for g, (p, q) in got.items()}
    assert set(model.places.tolist()) <= set(ratio) and len(model.places) == min(len(ratio), toxicity.KEPT)
    # a weight is a feature's ratio times its coefficient, so ratios of 0 carry nothing
    assert all(w == 0 for g, w in zip(model.places.tolist(), model.weights.tolist(), strict=True) if ratio[g] == 0)
    weight = dict(zip(model.places.tolist(), model.weights.tolist(), strict=True))
    out = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for p, (i, _) in enumerate(rows):
        z = model.intercept + sum(weight.get(g, 0.0) for g in held[p])
        assert out[i] == pytest.approx(1 / (1 + math.exp(-z)))
    again = toxicity.fit(docs.unionByName(docs), labels.unionByName(labels).unionByName(labels.filter("doc_id < 9").withColumn("toxic", F.lit(1))))
    assert (again.places == model.places).all() and abs(again.weights - model.weights).max() < 1e-6


def test_items_without_id_and_repeated_items(spark):
    passage, other = (" ".join(f"{x}{i}" for i in range(14)) for x in "pq")
    docs = table(spark, [(1, f"before {passage} after"), (2, other), (3, "clean words"), (4, None)])
    bench = spark.createDataFrame([(None, passage, 1), ("b", other, 1), ("b", other, 2), ("c", None, 1)], "item_id string, text string, frag int")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontam.decontaminate(docs, bench).collect()}
    assert got == {1: (16, 14, 0), 2: (14, 14, 1), 3: (2, 0, 0), 4: (0, 0, 0)}
    assert decontam.decontaminate(docs, bench.limit(0)).filter("n_hit > 0").count() == 0 and decontam.decontaminate(docs.limit(0), bench).count() == 0
