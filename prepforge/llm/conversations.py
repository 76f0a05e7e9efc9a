"""Repair of conversations whose turns were lost, emptied, repeated, cut or given to the wrong speaker.

Rows are range-partitioned by conversation, turn (nulls first), role and text, so that a conversation of any length lies in neighbouring
partitions; equal rows travel once with their number. A task solves all whole conversations of its rows together by the persistent audit DP
(`auditdp`). Conversations that reach over the edge of a partition, or have more than ROWS rows, are cut into segments of at most ROWS
rows. A segment is solved from each of the four states, as a table of costs and of the order of its four strings. These tables (a row for each
segment) are chained by conversation, which gives every segment the states in which it begins and ends; then segments write their
edits. That a row was seen earlier is asked by hashes: each segment sends each distinct hash once.

Edits: keep (K) 0; rerole (R) to user or assistant 3; delete (D) 4, required for blank rows and duplicates; insert (I) an empty row of user or
assistant 3; a truncated row that is not deleted 3 more. The cheapest edits whose role initials are nothing, or an optional s and pairs ua;
of equally cheap ones those whose initials are least in ASCII order.

Defined cases: a null role or text is one space; rows without conversation id are one conversation; null turns come first; rows of one turn
follow each other by role, then text; equal rows are duplicates of the first; a conversation none of whose rows is left has zeros and no edits;
an empty table gives no rows; a role without characters has no legal initial; texts of any length are carried whole; other columns are dropped,
whatever their names. The digest of a conversation streams over its segments in one task, since a hash has to read its text in order.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import auditdp as dp
from . import shared
from .textcore import parts

#: Rows of a segment; a conversation of more is cut. Rows and bytes that a task solves at once.
ROWS, AT_ONCE, BYTES = 256, 8192, 4 << 20
WHITE, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Pairs of role codes that may follow each other: su, ua, au, as 4 * first + second.
LEGAL = (1, 6, 9)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of rows that a rule of their key drops, empties, robs of their sentence ends, repeats or gives to the user."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20)).alias("x"))
    text = F.when(F.col("x") == 1, "").when(F.col("x") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    return rows.filter("x > 0").select("conv_id", "turn", F.when(F.col("x") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("x") == 3, 2).otherwise(1).alias("copies"))


def packed_rows(rows: list) -> bytes:
    raw = json.dumps(rows, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked_rows(body: bytes) -> list:
    return json.loads(pa.decompress(body[8:], decompressed_size=int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True).decode("utf-8", "surrogatepass"))


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch once, with their number."""
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by(["conv", "turn", "role", "text"], use_threads=False).aggregate([("copies", "sum")])
        yield from t.select(["conv", "turn", "role", "text", "copies_sum"]).rename_columns(["conv", "turn", "role", "text", "copies"]).to_batches()


class _Rows:
    """Rows (turn, role, text) of conversations one after another, with their faults. seen: for each row whether an earlier part of its conversation holds it."""

    def __init__(self, turns: list, roles: list[str], texts: list[str], size: np.ndarray, seen: list[bool] | None = None):
        self.turns, self.roles, self.texts, self.size = turns, roles, texts, size
        self.begin = np.cumsum(size) - size
        n = len(roles)
        self.code = np.fromiter((dp.INITIALS.get(r[:1], dp.OTHER) for r in roles), np.int8, n)
        ends = [t.rstrip(WHITE)[-1:] for t in texts]
        self.blank = np.fromiter((not e for e in ends), bool, n)
        cut = np.fromiter((e not in ENDS for e in ends), bool, n)
        again = np.zeros(n, bool)
        for a, k in zip(self.begin.tolist(), size.tolist(), strict=True):
            held: set = set()
            for i in range(a, a + k):
                row = (roles[i], texts[i])
                again[i] = row in held
                held.add(row)
        if seen is not None:
            again |= np.array(seen, bool)
        self.again = again & ~self.blank
        self.cut = cut & ~self.blank & ~self.again
        pairs = self.code[:-1] * 4 + self.code[1:]
        self.illegal = np.zeros(n, bool)  # of a row and the one before it in its conversation
        self.illegal[1:] = ~np.isin(pairs, LEGAL)
        self.illegal[self.begin] = False

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x.astype(np.int64), self.begin) if len(self.begin) else np.zeros(0, np.int64)

    def turn_spans(self) -> list[tuple]:
        """Least, largest and number of distinct turns, and the first and last turn, of each conversation; turns are in order, nulls first."""
        out = []
        for a, k in zip(self.begin.tolist(), self.size.tolist(), strict=True):
            known = [t for t in self.turns[a : a + k] if t is not None]
            out.append((known[0], known[-1], len(set(known)), self.turns[a], self.turns[a + k - 1]) if known else (None, None, 0, None, None))
        return out

    def solved(self, entry: np.ndarray) -> tuple:
        return dp.solve(self.code, self.blank | self.again, self.cut, self.begin, self.size, entry)


def _whole(keys: list, rows: _Rows, part: int) -> dict:
    """Results of whole conversations."""
    tree, cost, node = rows.solved(np.zeros(len(keys), np.int64))
    last = dp.chosen(tree, np.minimum(cost + dp.END, dp.INF), node)
    at = np.arange(len(keys))
    audits = [a + "I" * len(dp.END_ROLES[s]) for a, s in zip(tree.strings(node[at, last]), last.tolist(), strict=True)]
    bodies = []
    for a, k, letters in zip(rows.begin.tolist(), rows.size.tolist(), audits, strict=True):
        bodies.append(packed_rows(dp.edited(letters, list(zip(rows.roles[a : a + k], rows.texts[a : a + k], strict=True)), dp.START)))
    gaps = [hi - lo + 1 - n if n else 0 for lo, hi, n, _, _ in rows.turn_spans()]
    n = len(keys)
    return {"conv": keys, "part": [part] * n, "seq": [-1] * n, "gaps": gaps, "blank": rows.sums(rows.blank), "duplicate": rows.sums(rows.again), "truncated": rows.sums(rows.cut), "illegal": rows.sums(rows.illegal), "cost": cost[at, last] + dp.END[last], "audit": audits, "body": bodies}  # fmt: skip


def _segments(key, rows: list[tuple], part: int, seq: int) -> tuple[dict, int]:
    """Rows (turn, role, text, copies) of one conversation as segments of at most ROWS rows or, with more than one row, BYTES bytes."""
    bodies, own, n, size = [], [], 0, 0
    for turn, role, text, copies in rows:
        while copies:
            take = min(copies, ROWS - n)
            if n and (not take or size + len(text) > BYTES):
                bodies.append(packed_rows(own))
                own, n, size = [], 0, 0
                continue
            own.append((turn, role, text, take))
            n, size, copies = n + take, size + len(text), copies - take
    if own:
        bodies.append(packed_rows(own))
    k = len(bodies)
    none = {c: [None] * k for c in (*COUNTS, "audit")}
    return {"conv": [key] * k, "part": [part] * k, "seq": list(range(seq, seq + k)), **none, "body": bodies}, seq + k


def _packed(kind: pa.DataType):
    """A task's sorted rows as results of whole conversations (seq -1) and segments of the others."""
    schema = pa.schema([("conv", kind), ("part", pa.int32()), ("seq", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, n_held, size = shared.partition_id(), 0, [], 0, 0
        # the conversation of the last rows handed out as segments; at first any, as a task can't know what came before its rows
        state = {"any": True, "open": False, "key": None}

        def block(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal seq, held, n_held, size
            t = pa.Table.from_batches(held).to_pydict()
            conv, copies = t["conv"], t["copies"]
            edge = [0, *[i for i in range(1, len(conv)) if conv[i] != conv[i - 1]], len(conv)]
            whole, rest = [], (None, None)
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                begun = state["any"] or state["open"] and state["key"] == conv[a]
                tail = b == len(conv)
                n = sum(copies[a:b])
                state["any"] = False
                if tail and not last and not begun and n < ROWS:
                    rest = (a, b)
                    state["open"] = False
                elif begun or tail or n > ROWS:
                    out, seq = _segments(conv[a], [(t["turn"][i], t["role"][i], t["text"][i], copies[i]) for i in range(a, b)], part, seq)
                    state["open"], state["key"] = tail, conv[a]
                    yield shared.record_batch(schema, out)
                else:
                    whole.append((a, b))
            if whole:
                at = [[i for i in range(a, b) for _ in range(copies[i])] for a, b in whole]
                flat = [i for x in at for i in x]
                rows = _Rows([t["turn"][i] for i in flat], [t["role"][i] for i in flat], [t["text"][i] for i in flat], np.array([len(x) for x in at]))
                yield shared.record_batch(schema, _whole([conv[a] for a, _ in whole], rows, part))
            kept = pa.Table.from_batches(held).slice(rest[0]).combine_chunks().to_batches() if rest[0] is not None else []
            held, n_held = kept, sum(x.num_rows for x in kept)
            size = sum(x.nbytes for x in kept)

        for batch in batches:
            off = np.r_[0, np.cumsum([len(t) for t in batch.column(3).to_pylist()])] if batch.num_rows else np.zeros(1, np.int64)
            for lo, hi in parts(off, BYTES):
                held.append(batch.slice(lo, hi - lo))
                n_held, size = n_held + hi - lo, size + int(off[hi] - off[lo])
                if n_held >= AT_ONCE or size >= BYTES:
                    yield from block(False)
        if n_held:
            yield from block(True)

    return run


def _expanded(body: bytes) -> list[tuple]:
    return [(turn, role, text) for turn, role, text, copies in unpacked_rows(body) for _ in range(copies)]


def _digest(conv, role: str, text: str) -> bytes:
    return hashlib.sha256(json.dumps([conv, role, text]).encode()).digest()[:16]


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, part and seq of each distinct row of a segment."""
    for batch in batches:
        for conv, part, seq, body in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            own = list({_digest(conv, role, text) for _, role, text, _ in unpacked_rows(body)})
            yield pa.RecordBatch.from_pydict({"h": pa.array(own, pa.binary()), "part": pa.array([part] * len(own), pa.int32()), "seq": pa.array([seq] * len(own), pa.int64())})


def _tables(kind: pa.DataType):
    """Of a segment and the hashes that earlier segments hold: which rows were seen (bits), the table of costs and orders, counts, and what its ends need."""
    whole = (*COUNTS[1:5], "n_turns", "first_turn", "last_turn", "low", "high", "first_code", "last_code")
    schema = pa.schema([("conv", kind), ("part", pa.int32()), ("seq", pa.int64()), ("body", pa.binary()), ("seen", pa.binary()), ("costs", pa.list_(pa.int64())), ("orders", pa.list_(pa.int64())), *[(c, pa.int64()) for c in whole]])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        s, known = left.to_pylist()[0], set(right.column("h").to_pylist())
        rows = _expanded(s["body"])
        seen = [_digest(s["conv"], role, text) in known for _, role, text in rows]
        x = _Rows([r[0] for r in rows] * 4, [r[1] for r in rows] * 4, [r[2] for r in rows] * 4, np.full(4, len(rows)), seen * 4)
        tree, cost, node = x.solved(np.arange(4))
        low, high, n, first, last = x.turn_spans()[0]
        counts = [int(x.sums(v)[0]) for v in (x.blank, x.again, x.cut, x.illegal)]
        out = {"conv": s["conv"], "part": s["part"], "seq": s["seq"], "body": s["body"], "seen": bytes(seen), "costs": cost.ravel().tolist(), "orders": dp.ranks(tree, node).ravel().tolist(), **dict(zip(whole, [*counts, n, first, last, low, high, int(x.code[0]), int(x.code[len(rows) - 1])], strict=True))}
        return pa.Table.from_pylist([out], schema=schema)

    return run, schema


CHAINED = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("entry", pa.int64()), ("leave", pa.int64()), ("last", pa.bool_()), *[(c, pa.int64()) for c in COUNTS]])


def _chained(table: pa.Table) -> pa.Table:
    """The states in which each segment of a conversation begins and ends, and whether it is the last; the first segment carries the conversation's counts."""
    s = sorted(table.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    n = len(s)
    costs = np.array([r["costs"] for r in s], np.int64).reshape(n, 4, 4)
    togo = np.empty((n + 1, 4), np.int64)
    togo[n] = dp.END
    for i in range(n - 1, -1, -1):
        togo[i] = np.minimum((costs[i] + togo[i + 1]).min(axis=1), dp.INF)
    out, state = [], dp.START
    for i, r in enumerate(s):
        total = costs[i, state] + togo[i + 1]
        order = r["orders"][4 * state : 4 * state + 4]
        leave = min(np.flatnonzero(total == total.min()).tolist(), key=order.__getitem__)
        out.append({"part": r["part"], "seq": r["seq"], "entry": state, "leave": leave, "last": i == n - 1, **dict.fromkeys(COUNTS, 0)})
        state = leave
    twice = sum(b["first_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in zip(s[:-1], s[1:], strict=True))
    known = [r for r in s if r["n_turns"]]
    apart = sum(4 * a["last_code"] + b["first_code"] not in LEGAL for a, b in zip(s[:-1], s[1:], strict=True))
    total = lambda c: sum(r[c] for r in s)  # noqa: E731
    gaps = max(r["high"] for r in known) - min(r["low"] for r in known) + 1 - (total("n_turns") - twice) if known else 0
    out[0] |= {"gaps": gaps, "blank": total("blank"), "duplicate": total("duplicate"), "truncated": total("truncated"), "illegal": total("illegal") + apart, "cost": int(togo[0, dp.START])}
    return pa.Table.from_pylist(out, schema=CHAINED)


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and repaired rows of segments whose states are known."""
    for batch in batches:
        audits, bodies = [], []
        for s in batch.to_pylist():
            rows = _expanded(s["body"])
            x = _Rows(*[[r[i] for r in rows] for i in range(3)], np.array([len(rows)]), [bool(b) for b in s["seen"]])
            tree, _, node = x.solved(np.array([s["entry"]]))
            audit = tree.strings(node[0, [s["leave"]]])[0] + "I" * (len(dp.END_ROLES[s["leave"]]) * s["last"])
            audits.append(audit)
            bodies.append(packed_rows(dp.edited(audit, [(r[1], r[2]) for r in rows], s["entry"])))
        own = {c: batch.column(batch.schema.get_field_index(c)) for c in ("conv", "part", "seq", *COUNTS)}
        yield pa.RecordBatch.from_pydict(own | {"audit": pa.array(audits, pa.string()), "body": pa.array(bodies, pa.binary())})


def repair(rows: DataFrame) -> DataFrame:
    """conv, part, seq, the counts, audit and body (repaired rows, packed) of each whole conversation (seq -1) or segment; a conversation's segments follow each other by part and seq, and the first has its counts.

    rows: conv_id (an integer or text), turn (an integer), role, text and copies (how often the row stands there).
    """
    spark = rows.sparkSession
    shared.tune(spark)
    rows = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.col("copies").cast("long").alias("copies"))
    name = dict(rows.dtypes)["conv"]
    kind = pa.string() if name == "string" else pa.int64() if name == "bigint" else pa.int32()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    once = rows.mapInArrow(_combined, rows.schema)
    counts = ", ".join(f"{c} long" for c in COUNTS)
    made = shared.durable(once.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(_packed(kind), f"conv {name}, part int, seq long, {counts}, audit string, body binary"))
    cut = made.filter("seq >= 0").select("conv", "part", "seq", "body")
    if cut.isEmpty():
        return made
    sent = cut.mapInArrow(_sent, "h binary, part int, seq long")
    place = F.struct("part", "seq")
    firsts = sent.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    replies = sent.join(firsts, "h").filter(place > F.col("first")).select("part", "seq", "h")
    run, schema = _tables(kind)
    tables = shared.durable(cut.groupBy("part", "seq").cogroup(replies.groupBy("part", "seq")).applyInArrow(run, f"conv {name}, {shared.spark_schema(pa.schema(list(schema)[1:]))}"))
    states = tables.drop("body", "seen").groupBy("conv").applyInArrow(_chained, shared.spark_schema(CHAINED))
    known = tables.select("conv", "part", "seq", "body", "seen").join(states, ["part", "seq"])
    written = known.mapInArrow(_written, made.schema)
    return made.filter("seq < 0").unionByName(written)


def repaired_rows(pieces: DataFrame) -> DataFrame:
    """conv, part, seq, place, role and text of all rows after repair; a conversation's rows are in order of part, seq and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, body in enumerate(batch.column(3).to_pylist()):
                rows = unpacked_rows(body)
                own = {c: batch.column(k).take(pa.array([i] * len(rows), pa.int64())) for k, c in enumerate(("conv", "part", "seq"))}
                yield pa.RecordBatch.from_pydict(own | {"place": pa.array(range(len(rows)), pa.int64()), "role": pa.array([r[0] for r in rows], pa.string()), "text": pa.array([r[1] for r in rows], pa.string())})

    conv = dict(pieces.dtypes)["conv"]
    return pieces.select("conv", "part", "seq", "body").mapInArrow(run, f"conv {conv}, part int, seq long, place long, role string, text string")


def digests(pieces: DataFrame) -> DataFrame:
    """conv, the counts, audit and repaired_sha256 of each conversation; what is in several pieces is streamed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []  # conv, counts, audit pieces, hash, whether a row is in it

        def done() -> dict:
            return {"conv": now[0], **dict(zip(COUNTS, now[1], strict=True)), "audit": "".join(now[2]), "repaired_sha256": now[3].hexdigest()}

        for batch in batches:
            out = []
            for s in batch.to_pylist():
                if not now or s["seq"] < 0 or s["conv"] != now[0]:
                    if now:
                        out.append(done())
                    now = [s["conv"], [0] * len(COUNTS), [], hashlib.sha256(), False]
                now[1] = [a + s[c] for a, c in zip(now[1], COUNTS, strict=True)]
                now[2].append(s["audit"])
                for role, text in unpacked_rows(s["body"]):
                    now[3].update(f"{chr(10) if now[4] else ''}{role}:{text}".encode())
                    now[4] = True
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if now:
            yield pa.RecordBatch.from_pylist([done()], schema=schema)

    conv = dict(pieces.dtypes)["conv"]
    kind = {"string": pa.string(), "bigint": pa.int64()}.get(conv, pa.int32())
    schema = pa.schema([("conv", kind), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    names = f"conv {conv}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    apart = pieces.filter("seq >= 0").repartition(n, "conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(run, names)
    return pieces.filter("seq < 0").mapInArrow(run, names).unionByName(apart)


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    table = shared.pick(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    found = digests(repair(damaged(table)))
    ids = table.select("conv_id").distinct()
    out = ids.join(found, ids["conv_id"].eqNullSafe(found["conv"]), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


QUERIES = {"op13_conversation_repair": op13_conversation_repair}

#: crc32 of a text's bytes in DuckDB SQL, with a table of 256 steps made by rule (column t of relation crc_steps).
CRC_STEPS = "select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t"


def crc_sql(text: str) -> str:
    byte = f"list_transform(range(0, strlen({text})::bigint), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295, {byte}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


#: A state is its cost in nine digits and its audit, so that the least text is the best.
_THEN = "lpad((left({0}, 9)::int + {1})::varchar, 9, '0') || substr({0}, 10) || {2}"


def _then(state: str, cost: str, letter: str) -> str:
    return _THEN.format(state, cost, letter)


_RELAXED_U = f"least(u, {_then('e', '3', repr('I'))}, {_then('s', '3', repr('I'))}, {_then('a', '3', repr('I'))})"
_TURN_U = [_then(q, "case when code = 'u' then 0 else 3 end + trunc", "case when code = 'u' then 'K' else 'R' end") for q in ("e", "s", "a2")]
_TURN_A = _then("u2", "case when code = 'a' then 0 else 3 end + trunc", "case when code = 'a' then 'K' else 'R' end")
ORACLE = {
    "op13_conversation_repair": rf"""
with recursive crc_steps as ({CRC_STEPS}),
src as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
x as (select conv_id, turn, role, text, {crc_sql("k")} % 20 as x from src, crc_steps),
d as (select conv_id, turn, case when x = 4 then 'user' else role end as role, case x when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when x = 3 then 2 else 1 end)) as copy from x where x <> 0),
r as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i from d),
g as (select *, not regexp_matches(text, '[^ 	-]') as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as again, regexp_matches(text, '[^ 	-.!?][ 	-]*$') as cut, left(role, 1) as code, lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) as pair from r),
f as (select *, blank or again as must, case when cut and not blank and not again then 3 else 0 end as trunc from g),
n as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (again and not blank) as duplicate, count(*) filter (trunc > 0) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from f group by conv_id),
dp as (
  select conv_id, 0::bigint as i, '000000000' as e, null::varchar as s, null::varchar as u, null::varchar as a from n
  union all
  select conv_id, i, {_then("e", "4", "'D'")}, least({_then("s", "4", "'D'")}, case when code = 's' and not must then {_then("e", "trunc", "'K'")} end),
    least({_then("u2", "4", "'D'")}, case when not must then least({", ".join(_TURN_U)}) end), least({_then("a2", "4", "'D'")}, case when not must then {_TURN_A} end)
  from (select *, least(a, {_then("u2", "3", "'I'")}) as a2 from (select dp.conv_id, f.i, e, s, u, a, code, must, trunc, {_RELAXED_U} as u2 from dp join f on f.conv_id is not distinct from dp.conv_id and f.i = dp.i + 1))),
best as (select dp.conv_id, least(e, a, {_then("u", "3", "'I'")}, {_then("s", "6", "'II'")}) as b from dp join n on n.conv_id is not distinct from dp.conv_id and dp.i = n.n),
l as (select conv_id, substr(b, 10) as audit, unnest(string_split(substr(b, 10), '')) as letter, unnest(range(1, length(b) - 8)) as p from best),
o as (select *, count(*) filter (letter <> 'I') over w as i, count(*) filter (letter <> 'D') over w as o from l window w as (partition by conv_id order by p)),
q as (select o.conv_id, o.o, letter, role, coalesce(text, '') as text, max(case when o.o = 1 and letter = 'K' and code = 's' then 1 else 0 end) over (partition by o.conv_id) as shift from o left join f on f.conv_id is not distinct from o.conv_id and f.i = o.i and letter <> 'I' where letter <> 'D'),
t as (select conv_id, string_agg(case when letter = 'K' then role when (o - shift) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by o) as repaired from q group by conv_id)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(left(b, 9)::bigint, 0) as cost, coalesce(substr(b, 10), '') as audit, sha256(coalesce(repaired, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join n on n.conv_id is not distinct from c.conv_id left join best on best.conv_id is not distinct from c.conv_id left join t on t.conv_id is not distinct from c.conv_id""",
}
