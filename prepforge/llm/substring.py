"""Substring deduplication with fixed-block anchors.

Every document's words are cut into non-overlapping reference blocks of (window + 1) // 2 words. Any window of consecutive words holds
one whole block of its own document, so two equal windows share a block of one with a rolling block-wide window of the other. Three looks:

1. Index and probe: each fragment sends the hashes of its rolling block-wide windows, once each and marked if a reference block has it,
   to hash buckets; a bucket answers with one bit for each hash: it is a reference block somewhere and occurs in two documents or more.
2. Extend: windows over an anchored place are candidates; their 80-bit hashes (which count with the bucket's bits) go to buckets with the
   smallest doc_id of the fragment, and one bit returns: a smaller doc_id has it elsewhere.
3. Windows that a smaller document has are joined to maximal repeats, and the words that these cover are removed.

Defined cases: null or blank text has no words; rows without doc_id neither lose words nor stand as a source; rows of one doc_id are
one document, so they don't remove each other's words; an empty table gives no rows; texts are read whole, and of one that fills a fragment
alone the hashes are worked out a megabyte at a time; the columns that are not named are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .fragments import Fragments, by_bucket, from_low_bytes, groups_of, low_bytes, words_of
from .textcore import SPACE, U64, column_bytes, covered, mix, parts, windows
from .textcore import Words

WINDOW = 13
_KEY = U64((1 << 38) - 1)


def _ids(batch: pa.RecordBatch, key: str) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column(batch.schema.get_field_index(key)).cast(pa.int64())
    return col.fill_null(0).to_numpy(zero_copy_only=False), col.is_valid().to_numpy(zero_copy_only=False)


class _Anchors:
    """The distinct block-wide rolling windows of a fragment, in the order in which they are sent."""

    def __init__(self, h: np.ndarray, rows: np.ndarray, ids: np.ndarray, known: np.ndarray, block: int, buckets: int):
        g, at = windows(h, rows, block)
        at_ok = known[rows[at]] if len(at) else np.zeros(0, bool)
        g, self.at = g[at_ok], at[at_ok]
        row_first = np.searchsorted(rows, rows[self.at]) if len(self.at) else self.at
        aligned = (self.at - row_first) % block == 0
        order, begin, self.place = groups_of(g)
        self.order, self.n = order, len(begin)
        if self.n:
            doc = ids[rows[self.at[order]]]
            self.keys = g[order][begin]
            self.aligned = np.logical_or.reduceat(aligned[order], begin)
            self.several = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin)
        else:
            self.keys, self.aligned, self.several = np.zeros(0, U64), np.zeros(0, bool), np.zeros(0, bool)
        self.sent, self.bucket, self.edges = by_bucket(self.keys, buckets)

    def messages(self, frag: int) -> dict:
        entry = (self.keys >> U64(26)) | (self.aligned.astype(U64) << U64(38)) | (self.several.astype(U64) << U64(39))
        entry = entry[self.sent]
        return {"bucket": self.bucket, "frag": np.full(len(self.bucket), frag), "body": [low_bytes(entry[a:b], 5) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]}

    def hit(self, bits: dict[int, bytes], n: int) -> np.ndarray:
        """Which of n words begin an anchored block-wide window."""
        good = np.zeros(self.n, bool)
        for b, lo, hi in zip(self.bucket.tolist(), self.edges[:-1], self.edges[1:], strict=True):
            if b in bits:
                good[self.sent[lo:hi]] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=hi - lo).astype(bool)
        out = np.zeros(n, bool)
        if self.n:
            out[self.at[self.order]] = good[self.place]
        return out


class _Candidates:
    """The distinct candidate windows of a fragment with their smallest doc_id."""

    def __init__(self, h: np.ndarray, rows: np.ndarray, ids: np.ndarray, known: np.ndarray, hit: np.ndarray, window: int, block: int, buckets: int):
        g, at = windows(h, rows, window)
        sums = np.r_[0, np.cumsum(hit)]
        ok = (sums[at + window - block + 1] > sums[at]) & known[rows[at]] if len(at) else np.zeros(0, bool)
        g, self.at = g[ok], at[ok]
        more = windows(mix(h ^ U64(0x5851F42D4C957F2D)), rows, window)[0][ok] >> U64(48)
        self.order, begin, self.place = groups_of(g, more)
        self.n = len(begin)
        self.doc = ids[rows[self.at]]
        self.keys, self.more = g[self.order][begin], more[self.order][begin]
        self.least = np.minimum.reduceat(self.doc[self.order], begin) if self.n else np.zeros(0, np.int64)
        self.sent, self.bucket, self.edges = by_bucket(self.keys, buckets)

    def messages(self, frag: int) -> dict:
        pack = zstandard.ZstdCompressor(level=1)
        keys, more, least = self.keys[self.sent], self.more[self.sent], self.least[self.sent]
        body = [low_bytes(keys[a:b], 8) + low_bytes(more[a:b], 2) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]
        docs = [pack.compress(np.ascontiguousarray(least[a:b].view(np.uint8).reshape(-1, 8).T).tobytes()) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]
        return {"bucket": self.bucket, "frag": np.full(len(self.bucket), frag), "body": body, "docs": docs}

    def repeated(self, bits: dict[int, bytes]) -> np.ndarray:
        """The starts of windows that a document with a smaller doc_id has."""
        elsewhere = np.zeros(self.n, bool)
        for b, lo, hi in zip(self.bucket.tolist(), self.edges[:-1], self.edges[1:], strict=True):
            if b in bits:
                elsewhere[self.sent[lo:hi]] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=hi - lo).astype(bool)
        if not self.n:
            return np.zeros(0, np.int64)
        place = np.empty(len(self.at), np.int64)
        place[self.order] = self.place
        return self.at[elsewhere[place] | (self.doc > self.least[place])]


def _answer(table: pa.Table, good: np.ndarray, sizes: np.ndarray, kind: int) -> pa.Table:
    """Bits for each message that has any."""
    edges = np.r_[0, np.cumsum(sizes)]
    rows = [i for i in range(len(sizes)) if good[edges[i] : edges[i + 1]].any()]
    taken = table.select(["frag", "bucket"]).take(pa.array(rows, pa.int64()))
    return taken.append_column("kind", pa.array([kind] * len(rows), pa.int32())).append_column("bits", pa.array([np.packbits(good[edges[i] : edges[i + 1]]).tobytes() for i in rows], pa.binary()))


def _shared_blocks(table: pa.Table) -> pa.Table:
    blobs = table.column("body").to_pylist()
    sizes = np.array([len(x) // 5 for x in blobs])
    e = from_low_bytes(b"".join(blobs), 5)
    order, begin, place = groups_of(e & _KEY)
    s = e[order]
    aligned = np.logical_or.reduceat((s >> U64(38)) & U64(1) == 1, begin)
    several = np.logical_or.reduceat(s >> U64(39) == 1, begin) | (np.diff(np.r_[begin, len(s)]) > 1)
    good = np.zeros(len(e), bool)
    good[order] = (aligned & several)[place]
    return _answer(table, good, sizes, 1)


def _smaller_elsewhere(table: pa.Table) -> pa.Table:
    unpack = zstandard.ZstdDecompressor()
    blobs = table.column("body").to_pylist()
    sizes = np.array([len(x) // 10 for x in blobs])
    keys = np.concatenate([np.frombuffer(x[: 8 * n], "<u8") for x, n in zip(blobs, sizes, strict=True)])
    more = from_low_bytes(b"".join(x[8 * n :] for x, n in zip(blobs, sizes, strict=True)), 2)
    docs = np.concatenate([np.ascontiguousarray(np.frombuffer(unpack.decompress(x), np.uint8).reshape(8, -1).T).view(np.int64).ravel() for x in table.column("docs").to_pylist()])
    order, begin, place = groups_of(keys, more)
    least = np.minimum.reduceat(docs[order], begin)
    good = np.zeros(len(keys), bool)
    good[order] = least[place] < docs[order]
    return _answer(table, good, sizes, 2)


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of True."""
    edge = np.diff(np.r_[0, places.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, keep: list[str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Removes the words of windows that a document with a smaller doc_id also has.

    Returns the key, the columns in keep, text (the kept words joined by one space), n_words, n_removed and removed: the maximal runs of
    removed words as begin, end, begin, end, ... counted in words of the input.
    """
    block = (window + 1) // 2
    columns = [key, text, *[c for c in keep or [] if c not in (key, text)]]
    frags = Fragments(docs, columns, text)
    buckets = frags.buckets

    def opened(batch: pa.RecordBatch):
        h, rows, counts = words_of(batch, text, SPACE, False)
        ids, known = _ids(batch, key)
        return h, rows, counts, ids, known

    def bits(replies: pa.Table, kind: int) -> dict[int, bytes]:
        return {b: x for b, k, x in zip(*(replies.column(c).to_pylist() for c in ("bucket", "kind", "bits")), strict=True) if k == kind}

    def index_and_probe(frag: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        h, rows, _, ids, known = opened(batch)
        yield pa.RecordBatch.from_pydict(_Anchors(h, rows, ids, known, block, buckets).messages(frag), schema=pa.schema([("bucket", pa.int64()), ("frag", pa.int64()), ("body", pa.binary())]))

    def extend(frag: int, batch: pa.RecordBatch, replies: pa.Table) -> pa.Table:
        h, rows, _, ids, known = opened(batch)
        hit = _Anchors(h, rows, ids, known, block, buckets).hit(bits(replies, 1), len(h))
        sent = _Candidates(h, rows, ids, known, hit, window, block, buckets).messages(frag)
        return pa.Table.from_pydict(sent, schema=pa.schema([("bucket", pa.int64()), ("frag", pa.int64()), ("body", pa.binary()), ("docs", pa.binary())]))

    def remove(frag: int, batch: pa.RecordBatch, replies: pa.Table) -> pa.Table:
        h, rows, counts, ids, known = opened(batch)
        hit = _Anchors(h, rows, ids, known, block, buckets).hit(bits(replies, 1), len(h))
        starts = _Candidates(h, rows, ids, known, hit, window, block, buckets).repeated(bits(replies, 2))
        gone = covered(starts, window, len(h))
        edges = np.r_[0, np.cumsum(counts)]
        sums = np.r_[0, np.cumsum(gone)]
        n_removed = sums[edges[1:]] - sums[edges[:-1]]
        data, off = column_bytes(batch.column(1))
        kept, spans = [], []
        for lo, hi in parts(off, 1 << 20):
            w = Words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], SPACE, False)
            raw = data[off[lo] : off[hi]].tobytes()
            for r in range(lo, hi):
                a, b = off[r] - off[lo], off[r + 1] - off[lo]
                if not n_removed[r]:
                    kept.append(b" ".join(raw[a:b].split()))
                    spans.append([])
                    continue
                f = w.row_first[r - lo]
                begin, end = _runs(gone[edges[r] : edges[r + 1]])
                cut = np.c_[np.r_[0, end], np.r_[begin, counts[r]]]
                kept.append(b" ".join(b" ".join(raw[w.starts[f + x] : w.ends[f + y - 1]].split()) for x, y in cut.tolist() if y > x))
                spans.append(np.c_[begin, end].ravel().tolist())
        out = {c: batch.column(i) for i, c in enumerate(columns)}
        out[text] = pa.array([x.decode() for x in kept], pa.string())
        out |= {"n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "removed": pa.array(spans, pa.list_(pa.int32()))}
        return pa.Table.from_pydict(out)

    reply = "frag long, bucket long, kind int, bits binary"
    probes = frags.map(index_and_probe, "bucket long, frag long, body binary")
    anchored = shared.durable(probes.groupBy("bucket").applyInArrow(_shared_blocks, reply))
    candidates = frags.with_replies(anchored, extend, "bucket long, frag long, body binary, docs binary")
    smaller = candidates.groupBy("bucket").applyInArrow(_smaller_elsewhere, reply)
    return frags.with_replies(anchored.unionByName(smaller), remove, frags.schema(docs, "n_words long, n_removed long, removed array<int>"))


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op4_substring_dedup": op4_substring_dedup}
ORACLE = {
    "op4_substring_dedup": """
with w as (
  select doc_id, i, word from (
    select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from (
      select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from documents))),
g as (
  select doc_id, i, lead(i, 12) over (partition by doc_id order by i) as last,
    string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 12 following) as win
  from w),
m as (select win, min(doc_id) as least from g where last is not null group by win),
hit as (select distinct g.doc_id, unnest(range(g.i, g.i + 13)) as i from g join m using (win) where g.last is not null and m.least < g.doc_id),
k as (
  select w.doc_id, count(*) as n_words, count(hit.i) as n_removed,
    string_agg(w.word, ' ' order by w.i) filter (where hit.i is null) as kept
  from w left join hit on w.doc_id = hit.doc_id and w.i = hit.i group by w.doc_id)
select d.doc_id, coalesce(k.n_words, 0) as n_words, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256
from documents d left join k using (doc_id)""",
}
