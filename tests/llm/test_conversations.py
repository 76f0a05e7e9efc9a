"""Conversation repair against a search over all edits, with segments of a few rows, and the DuckDB SQL of its query."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from prepforge.llm import auditdp, conversations

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def faults(rows):
    out, held = [], set()
    for role, text in rows:
        e = re.sub(r"[\x20\x09-\x0D]+$", "", text)[-1:]
        out.append("blank" if not re.search(r"[^\x20\x09-\x0D]", text) else "duplicate" if (role, text) in held else "truncated" if e not in ".!?" else "")
        held.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, audit, rows) by going back from the end: what is best from row i in state q."""
    far = (10**9, "", ())
    best = [far] * 4
    for i in range(len(rows), -1, -1):
        own = [(0, "", ()) if i == len(rows) and q in (0, 3) else far for q in range(4)]
        if i < len(rows):
            role, text = rows[i]
            for q in range(4):
                c, a, r = best[q]
                options = [(c + 4, "D" + a, r)]
                if marks[i] not in ("blank", "duplicate"):
                    for to, letter, price in ((role, "K", 0), ("user", "R", 3), ("assistant", "R", 3)):
                        if (q, to[:1]) in NEXT:
                            c, a, r = best[NEXT[q, to[:1]]]
                            options.append((c + price + 3 * (marks[i] == "truncated"), letter + a, ((to, text), *r)))
                own[q] = min([own[q], *options])
        for _ in range(3):
            for (q, x), p in NEXT.items():
                if x != "s":
                    c, a, r = own[p]
                    own[q] = min(own[q], (c + 3, "I" + a, (("user" if x == "u" else "assistant", ""), *r)))
        best = own
    return best[0]


def expected(table):
    """conv_id to its row, from (conv_id, turn, role, text)."""
    by = {}
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        x = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text
        by.setdefault(conv, []).extend([(turn, "user" if x == 4 else role, text)] * (0 if x == 0 else 2 if x == 3 else 1))
    out = {}
    for conv, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {r[0] for r in rows if r[0] is not None}
        body = [r[1:] for r in rows]
        marks = faults(body)
        cost, audit, left = cheapest(body, marks)
        pairs = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(body[:-1], body[1:], strict=True))
        text = "\n".join(f"{r}:{t}" for r, t in left)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[marks.count(m) for m in ("blank", "duplicate", "truncated")], pairs, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def made(seed: int, n: int = 60):
    rng = random.Random(seed)
    said = ["Yes.", "No!", "Why?", "cut off", "", " \t", None, "Ünï. ", "a.b", "x" * 5000 + ".", "line\nof. two "]
    rows = []
    for conv in [*range(n), None]:
        long = conv in (7, 8, 20, None)
        for turn in range(rng.choice((150, 90)) if long else rng.randrange(1, 9)):
            text = rng.choice(said) if rng.random() < 0.4 else f"{rng.randrange(10**6)}{rng.choice('.!?,')}"
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", None, "", "udo"))
            rows.append((conv, rng.choice((None, turn, turn, turn, turn + 3)), role, text))
    rows += [(9, 1, "user", "again.")] * 40 + [(100, None, None, None), (101, 5, "system", "Only this.")]
    rng.shuffle(rows)
    return rows


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, "z", "q") for r in rows], "conv_id long, turn long, role string, text string, part int, seq long, body string, conv string").repartition(parts)


def rows_of(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("rows_each", [256, 3])
def test_repair_equals_a_search_over_all_edits(spark, tmp_path, monkeypatch, rows_each):
    monkeypatch.setattr(conversations, "ROWS", rows_each)
    monkeypatch.setattr(conversations, "AT_ONCE", 200)
    rows = made(rows_each)
    table(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = conversations.op13_conversation_repair(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    have, want = rows_of(got), expected(rows)
    assert have == want and len(want) == 63
    # the repaired rows themselves
    pieces = conversations.repair(conversations.damaged(table(spark, rows)))
    texts = {}
    for r in sorted(conversations.repaired_rows(pieces).collect(), key=lambda r: (r.part, r.seq, r.place)):
        texts.setdefault((r.conv), []).append(f"{r.role}:{r.text}")
    for conv, row in want.items():
        assert hashlib.sha256("\n".join(texts.get(conv, [])).encode()).hexdigest() == row[-1]


def test_repair_of_few_rows(spark, tmp_path):
    assert conversations.repair(conversations.damaged(table(spark, made(1)).limit(0))).count() == 0
    one = [(5, 0, "user", "Hello.")] * 700  # one row very often: its crc keeps it
    assert zlib.crc32(b"5:0") % 20 > 4
    got = conversations.digests(conversations.repair(conversations.damaged(table(spark, one)))).collect()
    assert [(r.conv, r.duplicate, r.cost, r.audit) for r in got] == [(5, 699, 4 * 699 + 3, "K" + "D" * 699 + "I")]


def test_order_of_strings(monkeypatch):
    rng = random.Random(2)
    tree = auditdp.Tree(40)
    nodes, text = [np.array([0], np.int32)], [""]
    for _ in range(600):
        i = rng.randrange(len(nodes))
        if len(text[i]) < 40:
            x = rng.choice("AB")
            nodes.append(tree.add(nodes[i], ord(x)))
            text.append(text[i] + x)
    flat = np.concatenate(nodes)
    a, b = np.array([rng.randrange(len(flat)) for _ in range(5000)]), np.array([rng.randrange(len(flat)) for _ in range(5000)])
    want = [text[i] < text[j] for i, j in zip(a, b, strict=True)]
    assert tree.strings(flat) == text
    assert tree.less(flat[a], flat[b]).tolist() == want
    tree.hash[:] = tree.depth  # all strings of one length collide: only the check of letters tells them apart
    assert tree.less(flat[a], flat[b]).tolist() == want
