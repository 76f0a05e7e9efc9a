"""Token files: byte-level BPE ids of a corpus in id order, each shard compressed by a grammar of id pairs (Re-Pair).

A shard holds about a million ids of whole documents. Frequent pairs of neighbouring symbols are replaced by new symbols, round after
round, until no pair occurs MIN_COUNT times or no symbol of 16 bits is left (a round replaces up to RULES_A_ROUND pairs); no rule crosses the end id, so a document is a range of symbols. Stored are the symbols, the rules (two
symbols each), the expansion length of every rule and the symbol count of every document: a reader decodes one document, or the ids from
any position, without the rest of the shard. Shards are rows of Parquet files under one path, numbered in ascending id order.

Defined cases: null is the empty text, which gives the end id alone; rows with a null id come first; rows of one id stay separate, in the
order of their texts; an empty table writes no shards; a text of any length is encoded whole and lies in one shard; other columns are dropped.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import shared
from .pairmerge import PairMerges
from .textcore import MIX_B, U64, byte_values, column_bytes, mix, parts, powers
from .wordbpe import byte_names, tokenizer_file

END_ID = 0
SHARD_TOKENS = 1 << 20
#: Symbols are 16 bits wide: ids of the vocabulary, then rules.
SYMBOLS = 1 << 16
MIN_COUNT, RULES_A_ROUND = 24, 2500
MEMORY_WORDS = 600_000
#: Bytes of text that are encoded at once.
ENCODED = 1 << 22
#: Bytes of the longest pre-token that is merged together with others.
LONG_TOKEN = 64
_SLOT_BITS = 18
#: Fixed value: the pattern of byte-level pre-tokens.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CUTS = b".,;:!?"
_CUT_TOKEN = regex.compile(r"[A-Za-z][.,;:!?]")
_CUT, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_CUT[list(CUTS)] = _LETTER[[*range(65, 91), *range(97, 123)]] = True
_NAMES = byte_names()
_MAY_BEGIN, _MAY_END = np.zeros(256, bool), np.zeros(256, bool)
for _c in map(chr, range(0x10000)):
    if _c.isspace():
        _MAY_BEGIN[_c.encode()[0]] = _MAY_END[_c.encode()[-1]] = True

_SHARDS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("base", pa.int32()), ("docs", pa.binary()), ("doc_symbols", pa.binary()), ("symbols", pa.binary()), ("rules", pa.binary()), ("lengths", pa.binary())])


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each text or byte string."""
    data, off = column_bytes(words)
    size = np.diff(off)
    full = np.flatnonzero(size)
    out = np.zeros(len(size), U64)
    if len(full):
        values = byte_values(1)[data] * powers(int(size.max()))[np.arange(len(data)) - np.repeat(off[:-1], size)]
        out[full] = np.add.reduceat(values, off[:-1][full])
    return mix(out + size.astype(U64) * MIX_B)


class _Index:
    """Numbers of hashes: open addressing, many at a time."""

    def __init__(self, most: int):
        self.bits = max(16, int(2 * most).bit_length())
        self.keys, self.at = np.zeros(1 << self.bits, U64), np.full(1 << self.bits, -1, np.int32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        out, left = np.full(len(h), -1), np.arange(len(h))
        slot = self._slot(h)
        while len(left):
            own = self.at[slot]
            hit = (own >= 0) & (self.keys[slot] == h[left])
            out[left[hit]] = own[hit]
            go = (own >= 0) & ~hit
            left, slot = left[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, h: np.ndarray, first: int) -> None:
        """Hashes that are not there get the numbers from first on; of equal ones the first counts."""
        left = np.unique(h, return_index=True)[1]
        left = left[self.find(h[left]) < 0]
        slot = self._slot(h[left])
        while len(left):
            free = np.flatnonzero(self.at[slot] < 0)
            won = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[won]], self.at[slot[won]] = h[left[won]], first + left[won]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, slot = left[stay], (slot[stay] + 1) & ((1 << self.bits) - 1)


class ByteBpe:
    """Ids by the tokenizers library, asked once for each distinct stretch between single blanks.

    A blank with a visible character on both sides always begins a new pre-token, and so does a mark of CUTS after an ASCII letter; so the
    text can be cut there. Texts with other blanks (doubled, or beside other white space) go to the library whole.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(spec)
        self.library.no_padding()
        self.library.no_truncation()
        self.size = self.library.get_vocab_size()
        if self.size > SYMBOLS:
            raise ValueError(f"ids of {self.size} do not fit symbols of 16 bits")
        #: Stretches that were met, in the order of the arrays below.
        self.known, self.index = pa.array([], pa.binary()), _Index(2 * MEMORY_WORDS)
        told = json.loads(spec)
        self.merges = PairMerges(told["model"])
        #: Whether marks may be cut off: no added token holds one after a letter.
        self.marks = not any(_CUT_TOKEN.search(t["content"]) for t in told.get("added_tokens", ()))
        self.flat, self.filled = np.zeros(1 << 16, np.uint16), 0
        self.begin = self.count = self.flags = self.used = np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _token_ids(self, raw: np.ndarray, size: np.ndarray, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens one after another, and the number of ids of each: short ones are merged at once, long ones by the library's model."""
        long = np.flatnonzero(size > LONG_TOKEN)
        if not len(long):
            return self.merges.ids(raw, size)
        short = size <= LONG_TOKEN
        ids, some = self.merges.ids(raw[np.repeat(short, size)], size[short])
        merge = self.library.model.tokenize
        other = [[x.id for x in merge((t if t.isascii() else t.encode().decode("latin-1")).translate(_NAMES))] for t in map(tokens.__getitem__, long.tolist())]
        count = np.zeros(len(size), np.int64)
        count[short], count[long] = some, list(map(len, other))
        flat = np.zeros(int(count.sum()), np.uint16)
        inside = np.repeat(short, count)
        flat[inside], flat[~inside] = ids, np.fromiter(chain.from_iterable(other), np.uint16)
        return flat, count

    def _learn(self, new: list[bytes]) -> None:
        """Encodes new stretches: those that begin with a blank and have visible ends are cut into pre-tokens as one text, since all cuts between them are safe."""
        size = np.fromiter(map(len, new), np.int64, len(new))
        raw = np.frombuffer(b"".join(new), np.uint8)
        end = np.cumsum(size)
        blank = (size > 0) & (np.r_[raw, 0][end - size] == 0x20)
        first, last = np.r_[raw, 0][np.minimum(end - size + blank, len(raw))], np.r_[0, raw][end]
        # bytes with which a white-space character may begin or end: only these are looked at as characters
        odd = np.flatnonzero((size <= blank) | _MAY_BEGIN[first] | _MAY_END[last])
        flags = np.zeros(len(new), np.int64)
        for i in odd.tolist():
            t = new[i].decode()
            t = t[1:] if t[:1] == " " else t
            flags[i] = (not t or t[0].isspace()) + 2 * (not t or t[-1].isspace())
        ok = (flags == 0) & blank & self.merges.alone
        for i in [i for i, w in enumerate(new) if b"<|" in w]:
            ok[i] = False
        safe, rest = np.flatnonzero(ok), np.flatnonzero(~ok)
        joined = raw[np.repeat(ok, size)]
        tokens = PRETOKEN.findall(joined.tobytes().decode())
        # from ends in characters to ends in bytes
        char_at = np.r_[np.flatnonzero((joined & 0xC0) != 0x80), len(joined)]
        token_end = char_at[np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))]
        ids, per_token = self._token_ids(joined, np.diff(np.r_[0, token_end]), tokens)
        # a stretch ends with the pre-token that ends where it does
        upto = np.searchsorted(token_end, np.cumsum(size[safe]), "right")
        count = np.zeros(len(new), np.int64)
        count[safe] = np.diff(np.r_[0, np.r_[0, np.cumsum(per_token)][upto]])
        alone = self._ids([new[i].decode() for i in rest.tolist()])
        count[rest] = [len(i) for i in alone]
        body = np.r_[ids, np.fromiter(chain.from_iterable(alone), np.uint16)]
        while self.filled + len(body) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros(len(self.flat), np.uint16)]
        self.flat[self.filled : self.filled + len(body)] = body
        order = np.r_[safe, rest]
        begin = np.zeros(len(new), np.int64)
        begin[order] = self.filled + np.cumsum(count[order]) - count[order]
        self.begin = np.r_[self.begin, begin]
        self.filled += len(body)
        self.count, self.flags, self.used = np.r_[self.count, count], np.r_[self.flags, flags], np.r_[self.used, np.zeros(len(new), np.int64)]

    def _forget(self) -> None:
        """Keeps the more used half of the stretches."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: MEMORY_WORDS // 2])
        count = self.count[keep]
        body = self._gather(keep)
        self.flat, self.filled = body.copy(), len(body)
        self.begin, self.count, self.flags, self.used = np.cumsum(count) - count, count, self.flags[keep], self.used[keep] // 2
        self.known, self.index = self.known.take(pa.array(keep)), _Index(2 * MEMORY_WORDS)
        self.index.add(word_hashes(self.known), 0)

    def _gather(self, k: np.ndarray) -> np.ndarray:
        count = self.count[k]
        ends = np.cumsum(count)
        return self.flat[np.repeat(self.begin[k] - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (bytes and offsets) one after another, each with the end id, and the number of ids of each."""
        if len(self.known) > MEMORY_WORDS:
            self._forget()
        if len(off) == 1:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        # a stretch begins with each text, at each blank, which stays with what follows, and at each mark after a letter
        begins = data == 0x20
        if self.marks and len(data):
            after = _CUT[data[1:]] & _LETTER[data[:-1]]
            after[off[(off > 0) & (off < len(data))] - 1] = False
            begins[1:] |= after
        cut = np.flatnonzero(begins)
        starts = np.sort(np.r_[off[:-1], cut], kind="stable")
        before = np.searchsorted(cut, off)
        sizes = np.diff(before) + 1
        first = before[:-1] + np.arange(len(sizes))
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.r_[starts, off[-1]].astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        h = word_hashes(words.dictionary)
        own = self.index.find(h)
        met = np.flatnonzero(own >= 0)
        own[met[~pc.equal(self.known.take(pa.array(own[met])), words.dictionary.take(pa.array(met))).to_numpy(zero_copy_only=False)]] = -1
        missing = np.flatnonzero(own < 0)
        if len(missing):
            n, new = len(self.count), words.dictionary.take(pa.array(missing))
            self._learn(new.to_pylist())
            self.known = pa.concat_arrays([self.known, new])
            if 2 * len(self.known) > len(self.index.at):
                self.index = _Index(2 * len(self.known))
                self.index.add(word_hashes(self.known), 0)
            else:
                self.index.add(h[missing], n)
            own[missing] = np.arange(n, n + len(missing))
        k = own[words.indices.to_numpy()]
        self.used += np.bincount(k, minlength=len(self.used))
        last = first + sizes - 1
        flags = self.flags[k]
        flags[first] &= 2
        flags[last] &= 1
        whole = np.add.reduceat(flags, first) > 0
        count = self.count[k]
        n = np.add.reduceat(count, first) + 1
        if not whole.any():
            out = np.zeros(int(n.sum()), np.uint16)
            inside = np.ones(len(out), bool)
            inside[np.cumsum(n) - 1] = False
            out[inside] = self._gather(k)
            out[~inside] = END_ID
            return out, n
        redone = dict(zip(np.flatnonzero(whole).tolist(), self._ids([data[off[i] : off[i + 1]].tobytes().decode() for i in np.flatnonzero(whole)]), strict=True))
        pieces = []
        for i in range(len(sizes)):
            own = np.array(redone[i], np.uint16) if i in redone else self._gather(k[first[i] : last[i] + 1])
            n[i] = len(own) + 1
            pieces += [own, np.array([END_ID], np.uint16)]
        return np.concatenate(pieces), n


_LOADED: dict[str, ByteBpe] = {}


def loaded(spec: str) -> ByteBpe:
    if spec not in _LOADED:
        _LOADED.clear()
        _LOADED[spec] = ByteBpe(spec)
    return _LOADED[spec]


def compress(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (two symbols a row) and expansion lengths of the rules; symbols from base on are rules."""
    s = ids.astype(np.uint32)
    rules, lengths = np.zeros((0, 2), np.uint32), np.zeros(0, np.int64)
    mult = np.uint32(0x9E3779B1)
    while True:
        room = min(RULES_A_ROUND, SYMBOLS - base - len(rules))
        if len(s) < 2 or room <= 0:
            break
        pair = (s[:-1] << np.uint32(16)) | s[1:]
        free = (s[:-1] != END_ID) & (s[1:] != END_ID)
        counted = np.sort(pair[free])
        at = np.flatnonzero(np.r_[True, counted[1:] != counted[:-1]]) if len(counted) else np.zeros(0, np.int64)
        n = np.diff(np.r_[at, len(counted)])
        often = np.flatnonzero(n >= MIN_COUNT)
        if not len(often):
            break
        often = often[np.lexsort((counted[at[often]], -n[often]))][:room]
        chosen = counted[at[often]]
        # one pair for each slot of a hash table; a pair that finds its slot taken waits for a later round
        slot = (chosen * mult) >> np.uint32(32 - _SLOT_BITS)
        chosen = chosen[np.sort(np.unique(slot, return_index=True)[1])]
        slot = (chosen * mult) >> np.uint32(32 - _SLOT_BITS)
        table, value = np.zeros(1 << _SLOT_BITS, np.uint32), np.zeros(1 << _SLOT_BITS, np.uint32)
        taken = np.zeros(1 << _SLOT_BITS, bool)
        table[slot], value[slot], taken[slot] = chosen, base + len(rules) + np.arange(len(chosen), dtype=np.uint32), True
        where = (pair * mult) >> np.uint32(32 - _SLOT_BITS)
        mark = free & (table[where] == pair) & taken[where]
        # of marked places in a row, every second one from the first, so that no symbol is used twice
        places = np.flatnonzero(mark)
        begins = np.r_[True, np.diff(places) > 1]
        run = np.maximum.accumulate(np.where(begins, np.arange(len(places)), 0))
        places = places[(np.arange(len(places)) - run) % 2 == 0]
        s = s.copy()
        s[places] = value[where[places]]
        gone = np.ones(len(s), bool)
        gone[places + 1] = False
        s = s[gone]
        a, b = chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)
        size = np.r_[np.ones(base, np.int64), lengths]
        lengths = np.r_[lengths, size[a] + size[b]]
        rules = np.r_[rules, np.c_[a, b]]
    return s.astype(np.uint16), rules.astype(np.uint16), lengths


def expansions(rules: np.ndarray, lengths: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids that symbols stand for, one symbol after another, with begin and length of each symbol."""
    size = np.r_[np.ones(base, np.int64), lengths]
    begin = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), np.uint16)
    flat[:base] = np.arange(base)
    for i, (a, b) in enumerate(rules.tolist()):
        p, k = begin[base + i], size[a]
        flat[p : p + k] = flat[begin[a] : begin[a] + k]
        flat[p + k : p + k + size[b]] = flat[begin[b] : begin[b] + size[b]]
    return flat, begin, size


def expand(symbols: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    flat, begin, size = table
    n = size[symbols]
    ends = np.cumsum(n)
    return flat[np.repeat(begin[symbols] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes docs and writes the shards under path, in ascending order of key."""
    spark = docs.sparkSession
    shared.tune(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def shard_of(part: int, number: int, docs_ids: list[pa.Array], tokens: list[np.ndarray], counts: list[np.ndarray], base: int) -> pa.RecordBatch:
        ids, n = np.concatenate(tokens), np.concatenate(counts)
        symbols, rules, lengths = compress(ids, base)
        # no rule holds an end id, but the text's own id 0 may stand anywhere: count symbols by their expansion
        size = np.r_[np.ones(base, np.int64), lengths][symbols]
        edges = np.searchsorted(np.cumsum(size), np.cumsum(n), "left") + 1
        keys = pa.chunked_array(docs_ids).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([(key, keys.type)])) as w:
            w.write_batch(pa.RecordBatch.from_arrays([keys], names=[key]))
        row = [part, number, len(ids), base, sink.getvalue().to_pybytes(), np.diff(np.r_[0, edges]).astype(np.int32).tobytes(), symbols.tobytes(), rules.tobytes(), lengths.astype(np.int32).tobytes()]
        return shared.record_batch(_SHARDS, dict(zip(_SHARDS.names, ([x] for x in row), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, number = loaded(spec.value), shared.partition_id(), 0
        ids, tokens, counts, size = [], [], [], 0
        for batch in batches:
            data, off = column_bytes(batch.column(1))
            for lo, hi in parts(off, ENCODED):
                t, n = bpe.encode(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                ends = np.r_[0, np.cumsum(n)]
                a = 0
                while a < hi - lo:
                    # as many documents as fill the shard
                    b = min(int(np.searchsorted(ends, ends[a] + shard_tokens - size, "left")), hi - lo)
                    ids.append(batch.column(0).slice(lo + a, b - a))
                    tokens.append(t[ends[a] : ends[b]])
                    counts.append(n[a:b])
                    size, a = size + int(ends[b] - ends[a]), b
                    if size >= shard_tokens:
                        yield shard_of(part, number, ids, tokens, counts, bpe.size)
                        number, ids, tokens, counts, size = number + 1, [], [], [], 0
        if ids:
            yield shard_of(part, number, ids, tokens, counts, bpe.size)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = shared.pick(docs, key, text).repartitionByRange(n, key).sortWithinPartitions(key, text)
    ordered.mapInArrow(run, shared.spark_schema(_SHARDS)).write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str, kind: str = "long", key: str = "doc_id") -> DataFrame:
    """Each document of the shards under path: key, part, shard, local (ids before it in its shard), n_tokens, ids (binary, unsigned 32-bit little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with pa.ipc.open_stream(pa.py_buffer(row["docs"])) as reader:
                    keys = reader.read_all().column(0).combine_chunks()
                rules, lengths = np.frombuffer(row["rules"], np.uint16).reshape(-1, 2), np.frombuffer(row["lengths"], np.int32).astype(np.int64)
                table = expansions(rules, lengths, row["base"])
                symbols, per_doc = np.frombuffer(row["symbols"], np.uint16), np.frombuffer(row["doc_symbols"], np.int32).astype(np.int64)
                edges = np.r_[0, np.cumsum(per_doc)]
                sums = np.r_[0, np.cumsum(table[2][symbols])]
                local = sums[edges]
                for lo in range(0, len(per_doc), 256):
                    hi = min(lo + 256, len(per_doc))
                    ids = expand(symbols[edges[lo] : edges[hi]], table).astype("<u4")
                    at = (local[lo : hi + 1] - local[lo]).tolist()
                    body = [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                    yield pa.RecordBatch.from_pydict({key: keys.slice(lo, hi - lo), "part": pa.array([row["part"]] * (hi - lo), pa.int32()), "shard": pa.array([row["shard"]] * (hi - lo), pa.int32()), "local": pa.array(local[lo:hi]), "n_tokens": pa.array(np.diff(local[lo : hi + 1])), "ids": pa.array(body, pa.binary())})

    shards = spark.read.schema(shared.spark_schema(_SHARDS)).parquet(path)
    return shards.mapInArrow(run, f"`{key}` {kind}, part int, shard int, local long, n_tokens long, ids binary")


def read_document(spark: SparkSession, path: str, part: int, shard: int, row: int) -> list[int]:
    """Random access: the ids of one document of a shard, from its own symbols only."""
    found = spark.read.schema(shared.spark_schema(_SHARDS)).parquet(path).filter((F.col("part") == part) & (F.col("shard") == shard)).first()
    per_doc = np.frombuffer(found["doc_symbols"], np.int32)
    begin = int(per_doc[:row].sum())
    symbols = np.frombuffer(found["symbols"], np.uint16)[begin : begin + per_doc[row]]
    rules = np.frombuffer(found["rules"], np.uint16).reshape(-1, 2)
    return expand(symbols, expansions(rules, np.frombuffer(found["lengths"], np.int32).astype(np.int64), found["base"])).tolist()


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each shard: sums within a part, and over the few parts."""
    shards = spark.read.schema(shared.spark_schema(_SHARDS)).parquet(path).select("part", "shard", "n_tokens")
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    part = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return shards.withColumn("within", F.coalesce(within, F.lit(0))).join(part, "part").select("part", "shard", (F.col("within") + F.col("before")).alias("begin"))


def _crc(ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return ids.withColumn("ids_crc32", F.crc32("ids"))


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = f"{shared.checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer_file("byte_bpe_50k.json"))
    found = _crc(read_tokens(spark, path, dict(docs.dtypes)["doc_id"])).drop("ids")
    return found.join(shard_starts(spark, path), ["part", "shard"]).select("doc_id", (F.col("begin") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


QUERIES = {"op5_token_files": op5_token_files}
ORACLE: dict[str, str] = {}
