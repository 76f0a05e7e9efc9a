"""Benchmark decontamination over a distributed positional inverted index.

The index is sharded by documents: each shard of a few megabytes of text stores, for every indexed term, the sorted places of its
postings (a place counts the words of the shard, with a gap between documents). Phrases are found as in a search engine: terms of a test
window are ordered from the rarest (by postings over the whole corpus), and their offset-adjusted lists are intersected in that order, so
that common words are looked up only at the few starts that the rare ones left.

Test windows are the stated query set: they go to the shards in blocks whose size is checked, one pass of the index for a block, and the
index holds the terms that these windows use. Matches of several blocks are merged by document.

Defined cases: null or blank text has no words; an item of no words has no window, an item with fewer words than the window is one window;
every row of the documents gives a row, also where a doc_id repeats; ids that are null stay null; an item without item_id hits words but counts as no
item of its own name; rows that repeat an item_id are one item; without documents there are no rows, and without items no hits; texts are read
whole; unused columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .fragments import words_of
from .textcore import NOT_ALNUM, column_bytes, parts

WINDOW = 10
#: Test windows of one pass over the index.
BLOCK_WINDOWS = 40_000
SHARD_BYTES = 3 << 20

_INDEX = pa.schema([("shard", pa.int64()), ("rows", pa.binary()), ("counts", pa.binary()), ("terms", pa.binary()), ("edges", pa.binary()), ("places", pa.binary())])
_MATCH = "shard long, row int, begins array<int>, ends array<int>, items array<string>"


def test_windows(benchmark: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """Each distinct window (terms array<long>: word hashes) with the items that hold it (as strings)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, _, counts = words_of(batch, text, NOT_ALNUM, True)
            h = h.view(np.int64)
            edges = np.r_[0, np.cumsum(counts)]
            names = batch.column(0).to_pylist()
            rows = [(h[a : a + min(window, n)], names[i]) for i, n in enumerate(counts) if n for a in range(edges[i], edges[i] + max(1, n - window + 1))]
            yield pa.RecordBatch.from_pydict({"terms": pa.array([r[0] for r in rows], pa.list_(pa.int64())), "item": pa.array([r[1] for r in rows], pa.string())})

    items = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").alias(text))
    return items.mapInArrow(run, "terms array<long>, item string").groupBy("terms").agg(F.collect_set("item").alias("items"))


def build_index(docs: DataFrame, terms: np.ndarray | None, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Shards of positional postings (durable), of all terms or of those given as sorted hashes; each keeps the key and the columns in keep of its rows."""
    spark = docs.sparkSession
    shared.tune(spark)
    known = None if terms is None else spark.sparkContext.broadcast(terms)

    def shard_of(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        h, rows, counts = words_of(batch, text, NOT_ALNUM, True)
        place = np.arange(len(h)) + rows
        if known is not None:
            t = known.value
            at = np.minimum(np.searchsorted(t, h), max(len(t) - 1, 0))
            ok = t[at] == h if len(t) else np.zeros(len(h), bool)
            h, place = h[ok], place[ok]
        order = np.argsort(h, kind="stable")
        s = h[order]
        begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
        ids = batch.select([key, *keep])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, ids.schema) as w:
            w.write_batch(ids)
        blobs = (sink.getvalue().to_pybytes(), counts.astype(np.int32).tobytes(), s[begin].tobytes(), np.r_[begin, len(s)].astype(np.int32).tobytes(), place[order].astype(np.int32).tobytes())
        return shared.record_batch(_INDEX, dict(zip(_INDEX.names, ([number], *([b] for b in blobs)), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = shared.partition_id() << 32, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            _, off = column_bytes(batch.column(1))
            for lo, hi in parts(off, shard_bytes // 4):
                held.append(batch.slice(lo, hi - lo))
                size += int(off[hi] - off[lo]) + 64 * (hi - lo)
                if size >= shard_bytes:
                    yield shard_of(held, number)
                    number, held, size = number + 1, [], 0
        if held:
            yield shard_of(held, number)

    return shared.durable(shared.pick(docs, key, text, *keep).mapInArrow(run, shared.spark_schema(_INDEX)))


class _Shard:
    def __init__(self, row: dict):
        self.counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.edges = np.frombuffer(row["edges"], np.int32)
        self.places = np.frombuffer(row["places"], np.int32)
        #: Place of the first word of each row, and of the end.
        self.first = np.r_[0, np.cumsum(self.counts + 1)]

    def lists(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term's list, -1 if it has none."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def postings(self, at: int) -> np.ndarray:
        return self.places[self.edges[at] : self.edges[at + 1]]


def _has(sorted_places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_places, wanted), len(sorted_places) - 1)
    return sorted_places[at] == wanted


def _phrases(shard: _Shard, lists: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the phrase: lists and offsets are ordered from the rarest term."""
    starts = shard.postings(lists[0]) - offsets[0]
    for at, off in zip(lists[1:], offsets[1:], strict=True):
        if not len(starts):
            break
        starts = starts[_has(shard.postings(at), starts + off)]
    return starts[starts >= 0]


def _near(shard: _Shard, lists: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends (exclusive) of stretches of at most span words of one document that hold all terms, one for each posting of the rarest."""
    pos = [shard.postings(at) for at in dict.fromkeys(lists.tolist())]
    p = pos[0]
    for other in pos[1:]:
        lo = np.searchsorted(other, p - span + 1)
        p = p[lo < np.searchsorted(other, p + span)]
    begins, ends = [], []
    for x in p.tolist():
        r = int(np.searchsorted(shard.first, x, "right")) - 1
        a, b = max(x - span + 1, int(shard.first[r])), min(x + span, int(shard.first[r + 1]) - 1)
        near = sorted((y, k) for k, q in enumerate(pos) for y in q[np.searchsorted(q, a) : np.searchsorted(q, b)].tolist())
        have, left, best = {}, 0, None
        for y, k in near:
            have[k] = have.get(k, 0) + 1
            while len(have) == len(pos):
                z, j = near[left]
                if z <= x <= y and y - z < span and (best is None or y - z < best[1] - best[0] - 1):
                    best = (z, y + 1)
                have[j] -= 1
                if not have[j]:
                    del have[j]
                left += 1
        if best:
            begins.append(best[0])
            ends.append(best[1])
    return np.array(begins, np.int64), np.array(ends, np.int64)


def _term_counts(index: DataFrame) -> DataFrame:
    """Postings of each term over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, edges in zip(batch.column("terms").to_pylist(), batch.column("edges").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"term": pa.array(np.frombuffer(terms, np.int64)), "n": pa.array(np.diff(np.frombuffer(edges, np.int32)).astype(np.int64))})

    return index.select("terms", "edges").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _search_block(index: DataFrame, windows: list, terms: DataFrame, proximity: int | None) -> DataFrame:
    """Matches of one block of windows, by shard and row."""
    spark = index.sparkSession
    counts = {r.term: r.n for r in _term_counts(index).join(terms, "term", "left_semi").collect()}  # at most the terms of this block
    plans, names = [], []
    for terms, items in windows:
        if all(t in counts for t in terms):
            order = sorted(range(len(terms)), key=lambda i: (counts[terms[i]], i))
            plans.append((np.array([terms[i] for i in order], np.int64).view(np.uint64), np.array(order, np.int64)))
            names.append(items)
    rarest = np.array([p[0][0] for p in plans], np.uint64)
    sent = spark.sparkContext.broadcast((plans, names, rarest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, names, rarest = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                shard = _Shard(row)
                spans: list[tuple[np.ndarray, np.ndarray, int]] = []
                for w in np.flatnonzero(shard.lists(rarest) >= 0).tolist():
                    terms, offsets = plans[w]
                    lists = shard.lists(terms)
                    if (lists < 0).any():
                        continue
                    if proximity is None:
                        begin = _phrases(shard, lists, offsets)
                        end = begin + len(terms)
                    else:
                        begin, end = _near(shard, lists, len(terms) + proximity)
                    if len(begin):
                        spans.append((begin, end, w))
                if not spans:
                    continue
                begin, end = (np.concatenate([s[i] for s in spans]) for i in (0, 1))
                which = np.concatenate([np.full(len(s[0]), s[2]) for s in spans])
                at = np.searchsorted(shard.first, begin, "right") - 1
                order = np.argsort(at, kind="stable")
                edges = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0, True])
                out = {"shard": [], "row": [], "begins": [], "ends": [], "items": []}
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    own = order[a:b]
                    r = int(at[own[0]])
                    out["shard"].append(row["shard"])
                    out["row"].append(r)
                    out["begins"].append(begin[own] - shard.first[r])
                    out["ends"].append(end[own] - shard.first[r])
                    out["items"].append(sorted({x for w in set(which[own].tolist()) for x in names[w]}))
                kinds = {"shard": pa.int64(), "row": pa.int32(), "begins": pa.list_(pa.int32()), "ends": pa.list_(pa.int32()), "items": pa.list_(pa.string())}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in out.items()})

    return index.mapInArrow(run, _MATCH)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, proximity: int | None = None, key: str = "doc_id", text: str = "text", block_windows: int = BLOCK_WINDOWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Words of each document inside a test window, and the items that such windows belong to.

    Returns key, the columns in keep, n_words, n_hit, n_items, items (sorted as strings), begins and ends of the hit runs (in words). With proximity, a match is
    a stretch of at most window + proximity words that holds all terms of a window in any order.
    """
    shared.tune(docs.sparkSession)
    windows = shared.durable(test_windows(benchmark, window, text=text))
    blocks = max(1, -(-windows.count() // block_windows))
    windows = windows.withColumn("block", F.pmod(F.xxhash64("terms"), F.lit(blocks)))
    used = windows.select(F.explode("terms").alias("term")).distinct()
    known = None
    if used.count() * 8 <= shared.BROADCAST_BYTES:
        known = np.sort(np.array([r.term for r in used.collect()], np.int64).view(np.uint64))
    index = build_index(docs, known, key, text, keep=keep)
    matches = None
    for b in range(blocks):
        block = windows.filter(F.col("block") == b)
        terms = block.select(F.explode("terms").alias("term")).distinct()
        found = _search_block(index, [(r.terms, r.items) for r in block.select("terms", "items").toLocalIterator()], terms, proximity)
        if blocks > 1:
            found = shared.durable(found)
        matches = found if matches is None else matches.unionByName(found)
    if blocks > 1:
        matches = matches.groupBy("shard", "row").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("begins", "ends")], F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    kinds = dict(docs.dtypes)
    matched = matches.withColumn("hits", F.struct("row", "begins", "ends", "items")).select("shard", "hits")

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        with pa.ipc.open_stream(pa.py_buffer(row["rows"])) as reader:
            own = reader.read_all().combine_chunks()
        counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
        hits = {h["row"]: h for h in right.column("hits").to_pylist()}
        n_hit, items, begins, ends = np.zeros(len(counts), np.int64), [[]] * len(counts), [[]] * len(counts), [[]] * len(counts)
        for r, h in hits.items():
            inside = np.zeros(int(counts[r]) + 1, np.int64)
            np.add.at(inside, np.array(h["begins"]), 1)
            np.add.at(inside, np.array(h["ends"]), -1)
            edge = np.diff(np.r_[0, (np.cumsum(inside) > 0).astype(np.int8), 0])
            begins[r], ends[r], items[r] = np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), sorted(h["items"])
            n_hit[r] = sum(ends[r]) - sum(begins[r])
        return pa.table({c: own.column(c) for c in (key, *keep)} | {"n_words": pa.array(counts), "n_hit": pa.array(n_hit), "n_items": pa.array([len(x) for x in items], pa.int64()), "items": pa.array(items, pa.list_(pa.string())), "begins": pa.array(begins, pa.list_(pa.int32())), "ends": pa.array(ends, pa.list_(pa.int32()))})

    heads = index.select("shard", "rows", "counts").groupBy("shard").cogroup(matched.groupBy("shard"))
    return heads.applyInArrow(rows, ", ".join(f"`{c}` {kinds[c]}" for c in (key, *keep)) + ", n_words long, n_hit long, n_items long, items array<string>, begins array<int>, ends array<int>")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = decontaminate(docs, benchmark)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLE = {
    "op8_decontaminate": r"""
with d as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from documents),
b as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from benchmark),
bw as (
  select distinct item_id, least(len(ws), 10) as k, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') as win
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as i from b where len(ws) > 0)),
sizes as (select distinct k from bw),
dw as (
  select doc_id, i, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') as win
  from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i from d, sizes where len(ws) >= k)),
m as (select dw.doc_id, dw.i, dw.k, bw.item_id from dw join bw on dw.k = bw.k and dw.win = bw.win),
h as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + k)) as j from m) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as items from (select distinct doc_id, cast(item_id as varchar) as s from m) group by doc_id)
select d.doc_id, len(d.ws) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(it.n_items, 0) as n_items,
  sha256(coalesce(it.items, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join it using (doc_id)""",
}
