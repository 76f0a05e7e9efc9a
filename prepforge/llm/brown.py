"""Perplexity by a class-based bigram model in Brown's manner.

P(w | v) = P(class(w) | class(v)) * P(w | class(w)). Classes of the CORE most frequent words come from exchange clustering: each word in turn
moves to the class that gains most likelihood, over the bigram counts of all training text. All other words get one exchange step against
COARSE classes of the core: each goes to the class that gains most likelihood from its counts before and after the classes of its core
neighbours, summed over all training text, and classes are split by frequency (powers of two, from 2 ** (BANDS - 1) on together). They are not
exchanged again. Words that training lacks share one event; half the weight of words seen once estimates it. Transitions are interpolated
with class frequencies (Witten-Bell). CORE bounds the table that the driver clusters; it does not bound what is counted or scored.

Every count covers all training documents. Words travel as 64-bit hashes: fragments of the corpus send their distinct words with counts
to hash buckets and get the sums and classes of exactly these words back, so that no vocabulary is broadcast or collected. Only
tables of fixed size reach the driver: the CORE words, their bigram matrix, and class transitions.

Defined cases: null or blank text has no words, only the end; rows without doc_id are scored but not learned from; rows of one doc_id stay
separate; with no training document every score is 0, as the base score then is; other columns are dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .fragments import Fragments, by_bucket, from_bytes, groups_of, words_of
from .textcore import SPACE, U64

FOLD, HELD = 7, 2
CORE, CLASSES, COARSE, BANDS, SWEEPS = 2048, 48, 14, 13, 6
#: Classes after those of the core: coarse classes (and one without any) by band, the end of a text, and unseen words.
END_CLASS = CLASSES + (COARSE + 1) * BANDS
UNSEEN = END_CLASS + 1
N_CLASSES = UNSEEN + 1
_BLOCKS, _FAN = 64, 64


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(n: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each word (in order of frequency) for the bigram counts n, by exchange from the start i mod classes."""
    k = len(n)
    g = np.arange(k) % classes
    one = np.zeros((k, classes))
    one[np.arange(k), g] = 1
    pairs = one.T @ n @ one
    for _ in range(sweeps):
        moved = 0
        for w in range(k):
            own = n[w, w]
            right, left = np.bincount(g, n[w], classes), np.bincount(g, n[:, w], classes)
            a = g[w]
            right[a] -= own
            left[a] -= own
            pairs[a] -= right
            pairs[:, a] -= left
            pairs[a, a] -= own
            rows, cols = pairs.sum(1) + left, pairs.sum(0) + right  # wherever the word goes, its neighbours' classes keep these
            f = _xlogx(pairs)
            gain = (_xlogx(pairs + right) - f).sum(1) + (_xlogx(pairs + left[:, None]) - f).sum(0)
            d = np.diag(pairs)
            both = right + left
            gain += _xlogx(d + both + own) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
            total_r, total_l = right.sum() + own, left.sum() + own
            gain -= _xlogx(rows + total_r) - _xlogx(rows) + _xlogx(cols + total_l) - _xlogx(cols)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            g[w] = b
            pairs[b] += right
            pairs[:, b] += left
            pairs[b, b] += own
        if not moved:
            break
    return g


def best_classes(pairs: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The class whose likelihood gains most from each word: rows of right and left count the classes after and before it; pairs are the class bigrams. Without counts, the number of classes."""
    d = np.diag(pairs)
    out = np.full(len(right), len(pairs))
    for lo in range(0, len(right), 8192):
        r, b = right[lo : lo + 8192].astype(float), left[lo : lo + 8192].astype(float)
        gain = (_xlogx(pairs + r[:, None, :]) - _xlogx(pairs)).sum(2) + (_xlogx(pairs.T + b[:, None, :]) - _xlogx(pairs.T)).sum(2)
        gain += _xlogx(d + r + b) - _xlogx(d + r) - _xlogx(d + b) + _xlogx(d)
        rows, cols = pairs.sum(1) + b, pairs.sum(0) + r
        gain -= _xlogx(rows + r.sum(1, keepdims=True)) - _xlogx(rows) + _xlogx(cols + b.sum(1, keepdims=True)) - _xlogx(cols)
        some = (r.sum(1) + b.sum(1)) > 0
        out[lo : lo + 8192][some] = gain[some].argmax(1)
    return out


class _Text:
    """A fragment's tokens, its distinct words in the order in which they are sent, and which documents train."""

    def __init__(self, batch: pa.RecordBatch, text: str, buckets: int):
        self.h, self.rows, self.counts = words_of(batch, text, SPACE, True)
        ids = batch.column(0).cast(pa.string()).to_pylist()
        self.held = np.array([i is not None and zlib.crc32(i.encode()) % FOLD == HELD for i in ids], bool)
        self.train = np.array([i is not None for i in ids], bool) & ~self.held
        self.buckets = buckets

    def distinct(self) -> None:
        order, begin, place = groups_of(self.h)
        self.keys = self.h[order][begin]
        self.word = np.empty(len(self.h), np.int64)
        self.word[order] = place
        self.sent, self.bucket, self.edges = by_bucket(self.keys, self.buckets)
        self.trained = np.bincount(self.word[self.train[self.rows]], minlength=len(self.keys)).astype(np.uint32)

    def pieces(self) -> Iterator[tuple[int, np.ndarray]]:
        for b, lo, hi in zip(self.bucket.tolist(), self.edges[:-1], self.edges[1:], strict=True):
            yield b, self.sent[lo:hi]


def _core_index(core: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each word among the sorted core hashes, -1 outside."""
    if not len(core):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(core, h), len(core) - 1)
    return np.where(core[at] == h, at, -1)


@dataclass(frozen=True)
class Model:
    """log10 of class transitions, tokens of each class, and the sizes for the base score."""

    transitions: np.ndarray
    class_tokens: np.ndarray
    tokens: int
    types: int
    documents: int


def _known(batch: pa.RecordBatch, replies: pa.Table, text: str, buckets: int) -> tuple[_Text, np.ndarray, np.ndarray]:
    """The fragment's text with training count and class of each token."""
    t = _Text(batch, text, buckets)
    t.distinct()
    got = {b: (n, k) for b, n, k in zip(*(replies.column(c).to_pylist() for c in ("bucket", "n", "kind")), strict=True)}
    n, kind = np.zeros(len(t.keys), np.int64), np.zeros(len(t.keys), np.int64)
    for b, s in t.pieces():
        n[s], kind[s] = _unpack(got[b][0], np.uint32), _unpack(got[b][1], np.uint8)
    return t, n[t.word], kind[t.word]


class BrownModel:
    """Learns from the training rows of docs; score() gives a row for each row of docs."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text"):
        self.docs, self.key, self.text = docs, key, text
        self.frags = Fragments(docs, [key, text], text)
        words, n_types, n_words, n_docs = self._vocabulary()
        order = np.argsort(words)
        self.core = words[order]
        bigrams = self._core_bigrams()[np.argsort(order)][:, np.argsort(order)] if len(words) else np.zeros((0, 0))
        fine, coarse = (exchange(bigrams, c) for c in (CLASSES, COARSE))
        one = np.eye(COARSE)[coarse]
        self.coarse_pairs = one.T @ bigrams @ one
        self.fine, self.coarse = fine[order], coarse[order]
        self.replies = shared.durable(self._assigned())
        self.model = self._transitions(n_words + n_docs, n_types + (n_docs > 0), n_docs)

    def _vocabulary(self) -> tuple[np.ndarray, int, int, int]:
        """The core words by falling frequency, and distinct words, words and documents of training."""
        text, buckets = self.text, self.frags.buckets

        def send(frag: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            t = _Text(batch, text, buckets)
            t.distinct()
            out = [(b, t.keys[s], t.trained[s]) for b, s in t.pieces()]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([x[0] for x in out] + [-1], pa.int64()), "words": pa.array([x[1].tobytes() for x in out] + [b""], pa.binary()), "n": pa.array([_pack(x[2]) for x in out] + [_pack(np.array([t.train.sum()], np.uint32))], pa.binary())})

        def add(table: pa.Table) -> pa.Table:
            n = np.concatenate([_unpack(x, np.uint32) for x in table.column("n").to_pylist()]).astype(np.int64)
            if table.column("bucket")[0].as_py() < 0:
                words, total = np.zeros(0, U64), n[:0]
                sums = {"types": 0, "words": 0, "docs": int(n.sum())}
            else:
                h = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()])
                order, begin, _ = groups_of(h)
                words, total = h[order][begin], np.add.reduceat(n[order], begin)
                words, total = words[total > 0], total[total > 0]
                sums = {"types": len(words), "words": int(total.sum()), "docs": 0}
            top = np.lexsort((words, -total))[:CORE]
            return pa.table({k: pa.array([v], pa.int64()) for k, v in sums.items()} | {"top": pa.array([words[top].view(np.int64)], pa.list_(pa.int64())), "top_n": pa.array([total[top]], pa.list_(pa.int64()))})

        sent = self.frags.map(send, "bucket long, words binary, n binary")
        # document counts have a bucket of their own; spread over several, so that none takes all fragments
        sent = sent.withColumn("part", F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("n"), F.lit(8))).otherwise(0))
        found = shared.durable(sent.groupBy("bucket", "part").applyInArrow(add, "types long, words long, docs long, top array<long>, top_n array<long>"))
        sums = found.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("types", "words", "docs")]).first()
        top = found.select(F.explode(F.arrays_zip("top", "top_n")).alias("x")).select("x.top", "x.top_n").orderBy(F.desc("top_n"), "top").limit(CORE).collect()
        return np.array([r.top for r in top], np.int64).view(U64), *map(int, sums)

    def _core_bigrams(self) -> np.ndarray:
        """Counts of neighbouring core words in training text, in the order of self.core."""
        core, text, buckets, k = self.core, self.text, self.frags.buckets, len(self.core)
        width = -(-k * k // _BLOCKS)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(width * _BLOCKS, np.int64)
            for batch in batches:
                for body in batch.column("body"):
                    t = _Text(from_bytes(body.as_py()), text, buckets)
                    c = _core_index(core, t.h)
                    ok = (c[:-1] >= 0) & (c[1:] >= 0) & (t.rows[:-1] == t.rows[1:]) & t.train[t.rows[:-1]] if len(c) else np.zeros(0, bool)
                    sums += np.bincount((c[:-1] * k + c[1:])[ok], minlength=len(sums)) if ok.any() else 0
            cut = sums.reshape(_BLOCKS, width)
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(_BLOCKS), pa.int32()), "fan": pa.array([shared.partition_id() % _FAN] * _BLOCKS, pa.int32()), "n": pa.array([_pack(x) for x in cut], pa.binary())})

        def add(table: pa.Table) -> pa.Table:
            total = np.sum([_unpack(x, np.int64) for x in table.column("n").to_pylist()], axis=0)
            return pa.table({"block": table.column("block").slice(0, 1), "n": pa.array([_pack(total)], pa.binary())})

        parts = self.frags.df.select("body").mapInArrow(count, "block int, fan int, n binary")
        one = parts.groupBy("block", "fan").applyInArrow(add, "block int, n binary")
        all_of = one.groupBy("block").applyInArrow(add, "block int, n binary").collect()  # CORE ** 2 numbers at most
        out = np.zeros((_BLOCKS, width))
        for r in all_of:
            out[r.block] = _unpack(bytes(r.n), np.int64)
        return out.ravel()[: k * k].reshape(k, k)

    def _assigned(self) -> DataFrame:
        """Replies to fragments: count and class of each word sent. Rows of frag -1 hold tokens by class."""
        core, fine, coarse, pairs, text, buckets = self.core, self.fine, self.coarse, self.coarse_pairs, self.text, self.frags.buckets

        def send(frag: int, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            t = _Text(batch, text, buckets)
            t.distinct()
            c = _core_index(core, t.keys)[t.word]
            group = np.where(c >= 0, coarse[c] if len(coarse) else 0, -1)
            votes = np.zeros(len(t.keys) * 2 * COARSE, np.int64)  # classes after each word, then before it
            if len(c) > 1:
                same = (t.rows[:-1] == t.rows[1:]) & t.train[t.rows[:-1]]
                for word, other, side in ((t.word[:-1], group[1:], 0), (t.word[1:], group[:-1], COARSE)):
                    ok = same & (other >= 0)
                    votes += np.bincount(word[ok] * 2 * COARSE + side + other[ok], minlength=len(votes))
            votes = votes.reshape(-1, 2 * COARSE).astype(np.uint32)
            out = [(b, t.keys[s].tobytes(), _pack(t.trained[s]), _pack(votes[s].T)) for b, s in t.pieces()]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([x[0] for x in out], pa.int64()), "frag": pa.array([frag] * len(out), pa.int64())} | {c: pa.array([x[i + 1] for x in out], pa.binary()) for i, c in enumerate(("words", "n", "votes"))})

        def assign(table: pa.Table) -> pa.Table:
            blobs = table.column("words").to_pylist()
            sizes = np.array([len(x) // 8 for x in blobs])
            h = np.frombuffer(b"".join(blobs), np.uint64)
            n = np.concatenate([_unpack(x, np.uint32) for x in table.column("n").to_pylist()]).astype(np.int64)
            votes = np.concatenate([_unpack(x, np.uint32).reshape(2 * COARSE, -1).T for x in table.column("votes").to_pylist()])
            order, begin, place = groups_of(h)
            words, total = h[order][begin], np.add.reduceat(n[order], begin)
            votes = np.add.reduceat(votes[order], begin, axis=0)
            side = best_classes(pairs, votes[:, :COARSE], votes[:, COARSE:])
            band = np.minimum(np.log2(np.maximum(total, 1)).astype(np.int64), BANDS - 1)
            kind = CLASSES + side * BANDS + band
            c = _core_index(core, words)
            kind[c >= 0] = fine[c[c >= 0]]
            kind[total == 0] = UNSEEN
            tokens = np.bincount(kind, weights=total, minlength=N_CLASSES)
            all_n, all_kind = np.empty(len(h), np.uint32), np.empty(len(h), np.uint8)
            all_n[order], all_kind[order] = total[place], kind[place]
            edges = np.r_[0, np.cumsum(sizes)]
            cut = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
            bucket = table.column("bucket")[0].as_py()
            return pa.table({
                "frag": pa.array([*table.column("frag").to_pylist(), -1], pa.int64()), "bucket": pa.array([bucket] * (len(cut) + 1), pa.int64()),
                "n": pa.array([*[_pack(all_n[a:b]) for a, b in cut], _pack(tokens)], pa.binary()), "kind": pa.array([*[_pack(all_kind[a:b]) for a, b in cut], b""], pa.binary()),
            })

        assert N_CLASSES <= 256
        sent = self.frags.map(send, "bucket long, frag long, words binary, n binary, votes binary")
        return sent.groupBy("bucket").applyInArrow(assign, "frag long, bucket long, n binary, kind binary")

    def _transitions(self, tokens: int, types: int, documents: int) -> Model:
        text, buckets = self.text, self.frags.buckets

        def count(frag: int, batch: pa.RecordBatch, replies: pa.Table) -> pa.Table:
            t, n, kind = _known(batch, replies, text, buckets)
            sums = np.zeros((N_CLASSES, N_CLASSES))
            ok = t.train[t.rows]
            rows, kind, once = t.rows[ok], kind[ok], n[ok] == 1
            first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
            last = np.r_[first[1:], True] if len(rows) else first
            before = np.where(first, END_CLASS, np.r_[0, kind[:-1]]) if len(rows) else kind
            for weight, prev, here in ((np.where(once, 0.5, 1.0), before, kind), (np.where(once, 0.5, 0.0), before, np.full(len(kind), UNSEEN)), (np.where(last & ~once, 1.0, 0.5) * last, kind, np.full(len(kind), END_CLASS))):
                sums += np.bincount(prev * N_CLASSES + here, weights=weight, minlength=N_CLASSES**2).reshape(N_CLASSES, -1)
            # a word seen once stands for unseen words as the one before, too
            prev_once = np.r_[False, once[:-1]] & ~first if len(rows) else first
            sums += np.bincount(UNSEEN * N_CLASSES + kind[prev_once], weights=np.full(int(prev_once.sum()), 0.5), minlength=N_CLASSES**2).reshape(N_CLASSES, -1)
            sums[END_CLASS, END_CLASS] += (t.train & (t.counts == 0)).sum()
            a, b = np.nonzero(sums)
            return pa.table({"a": pa.array(a.astype(np.int32)), "b": pa.array(b.astype(np.int32)), "n": pa.array(sums[a, b])})

        rows = self.frags.with_replies(self.replies.filter("frag >= 0"), count, "a int, b int, n double").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()  # N_CLASSES ** 2 at most
        n = np.zeros((N_CLASSES, N_CLASSES))
        for r in rows:
            n[r.a, r.b] = r.n
        total = n.sum(0) + 0.01
        back = total / total.sum()
        seen, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
        p = (n + np.maximum(kinds, 1) * back) / (seen + np.maximum(kinds, 1))

        def class_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(N_CLASSES)
            for batch in batches:
                for x in batch.column("n"):
                    total += _unpack(x.as_py(), np.float64)
            yield pa.RecordBatch.from_pydict({"c": pa.array(range(N_CLASSES), pa.int32()), "n": pa.array(total)})

        own = self.replies.filter("frag = -1").select("n").mapInArrow(class_tokens, "c int, n double").groupBy("c").agg(F.sum("n").alias("n")).collect()
        sizes = np.zeros(N_CLASSES)
        for r in own:
            sizes[r.c] = r.n
        return Model(np.log10(p), sizes, tokens, types, documents)

    def score(self) -> DataFrame:
        """key, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity."""
        key, m = self.key, self.model
        text, buckets = self.text, self.frags.buckets

        def run(frag: int, batch: pa.RecordBatch, replies: pa.Table) -> pa.Table:
            t, n, kind = _known(batch, replies, text, buckets)
            size = len(t.counts)
            base_unit = np.log10(m.tokens + m.types + 1)
            base = np.bincount(t.rows, weights=np.log10(n + 1), minlength=size) + np.log10(m.documents + 1) - base_unit * (t.counts + 1)
            known_n = np.bincount(t.rows[n > 0], minlength=size) + (m.documents > 0)
            first = np.r_[True, t.rows[1:] != t.rows[:-1]] if len(n) else np.zeros(0, bool)
            before = np.where(first, END_CLASS, np.r_[0, kind[:-1]]) if len(n) else kind
            emit = np.where(n > 0, np.log10(np.maximum(n, 1) / np.maximum(m.class_tokens[kind], 1)), 0.0)
            s = np.bincount(t.rows, weights=m.transitions[before, kind] + emit, minlength=size)
            final = np.full(size, END_CLASS)
            has = np.flatnonzero(t.counts)
            final[has] = kind[np.cumsum(t.counts)[has] - 1]
            s += m.transitions[final, END_CLASS]
            if not m.documents:
                s, base = np.zeros(size), np.zeros(size)
            tokens = t.counts + 1
            return pa.table({
                key: batch.column(0), "held_out": pa.array(t.held), "n_tokens": pa.array(tokens), "n_known": pa.array(known_n.astype(np.int64)), "train_tokens": pa.array(np.full(size, m.tokens)),
                "base_score": pa.array(base), "score": pa.array(s), "perplexity": pa.array(10 ** (-s / tokens)),
            })

        kind = dict(self.docs.dtypes)[key]
        return self.frags.with_replies(self.replies.filter("frag >= 0"), run, f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op1_brown_scores(spark, sf_dir: str) -> DataFrame:
    return BrownModel(spark.read.parquet(f"{sf_dir}/documents.parquet")).score()


QUERIES = {"op1_brown_scores": op1_brown_scores}
ORACLE: dict[str, str] = {}
