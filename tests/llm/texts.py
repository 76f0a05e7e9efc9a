"""Small tables with the hard cases: nulls, blanks, ties, repeats, long texts, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, frag long, bucket int, path string, node long, n long, y int, id string"


def words(rng: random.Random, n: int, size: int = 300) -> list[str]:
    return [f"w{rng.randrange(size)}" + rng.choice(["", "", "", ",", ".", "é"]) for _ in range(n)]


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, one long text, blanks and nulls."""
    rng = random.Random(seed)
    passage = words(rng, 20)
    out: list[tuple] = []
    for i in range(n):
        w = words(rng, rng.randrange(3, 120))
        kind = i % 6
        if kind == 1 and out:
            w = list(base)
        elif kind == 2 and out:
            w = list(base)
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = "changed"
        elif kind == 3:
            w = w[:30] + passage + w[30:]
        if kind == 0:
            base = w
        out.append((i, rng.choice([" ", "  ", "\n", "\t "]).join(w)))
    out += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "only three words"), (1004, "only three words"), (None, "a text without id of some words"), (1005, " ".join(words(rng, 30_000))), (1006, "İstanbul ǅ ﬁ \x85 <|endoftext|> O'Brien's ÀÉ 12 3.4  x")]
    return out


def table(spark, rows: list[tuple]):
    """documents with extra columns whose names clash with helpers."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 1, 2, "p", 3, 4, 1, "x") for i, t in rows], SCHEMA)
