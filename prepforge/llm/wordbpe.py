"""BPE encoding and decoding with word ends: speculate, verify, and merge exactly only where that fails.

The distinct words of a batch are cut into pieces, and a trie of the vocabulary proposes the greedy longest tokens of all pieces. A token
sequence is the BPE encoding if and only if every adjacent pair of tokens is the encoding of its own concatenation; so the distinct pairs
are checked once each, all pairs are looked up as one array, and pieces with a pair that doesn't hold are merged exactly by rank.

Defined cases: null is the empty text; a text of white space only has no ids; special tokens in a text get their own ids, as the library
gives them; rows of one doc_id stay separate rows; an empty table gives no rows; texts are encoded whole; other columns pass through.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import shared
from .textcore import column_bytes, parts

END = "</w>"
#: The final character of a piece is shifted by this, so that tokens with a word end match only there.
FINAL = 0x4000
#: Words kept by a worker; beyond it, those that were used least are forgotten.
MEMORY_WORDS = 300_000
#: Words of these characters alone are cut by PIECES; all others by the library's own normaliser and pre-tokenizer.
LATIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")
#: Fixed value: the tokenizer file's split pattern.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+| ")


def byte_names() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free code from 256."""
    out, free = {}, 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


_BYTE_NAMES = byte_names()


def _shift_last(piece: str) -> str:
    return piece[:-1] + chr(ord(piece[-1]) + FINAL)


class WordBpe:
    """A byte-level BPE with word ends, read from the text of a tokenizer file."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        self.tokens = dict(model["model"]["vocab"])
        self.names = {i: t for t, i in self.tokens.items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        form = lambda t: _shift_last(t[: -len(END)]) if t.endswith(END) and t != END else t
        self.ranks = {(form(a), form(b)): i for i, (a, b) in enumerate(merges)}
        self.forms = {form(t): i for t, i in self.tokens.items()}
        size = max(self.names) + 1
        self.text = [""] * size
        self.length = np.zeros(size, np.int64)
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for f, i in self.forms.items():
            self.trie.add_word(f, i)
            self.text[i], self.length[i] = f, len(f)
        self.trie.make_automaton()
        self.number = [str(i) for i in range(size)]
        self.name = [self.names.get(i, "") for i in range(size)]
        self.library = Tokenizer.from_str(spec)
        self.pairs: dict[int, bool] = {}
        self.used = np.zeros(0, np.int64)
        self.words: dict[bytes, int] = {}
        self.counts: list[int] = []
        self.ids: list[str] = []
        self.back: list[str] = []

    def forget(self) -> None:
        """Keeps the more used half of the words."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: MEMORY_WORDS // 2])
        place = np.full(len(self.used), -1)
        place[keep] = np.arange(len(keep))
        self.words = {w: int(p) for w, i in self.words.items() if (p := place[i]) >= 0}
        self.counts, self.ids, self.back = ([x[i] for i in keep.tolist()] for x in (self.counts, self.ids, self.back))
        self.used = self.used[keep] // 2

    def merge_pair(self, form: str) -> list[int]:
        """The exact encoding of a short text: the pair of least rank first, from the left among equals."""
        part, get, none = list(form), self.ranks.get, 1 << 30
        rank = [get(x, none) for x in zip(part, part[1:])]  # noqa: B905
        while rank and (r := min(rank)) < none:
            i = rank.index(r)
            part[i] += part.pop(i + 1)
            rank.pop(i)
            if i < len(rank):
                rank[i] = get((part[i], part[i + 1]), none)
            if i:
                rank[i - 1] = get((part[i - 1], part[i]), none)
        return [self.forms[p] for p in part]

    def merge_piece(self, form: str) -> list[int]:
        """The exact encoding of a whole piece, of any length, by the library's merging."""
        return [t.id for t in self.library.model.tokenize(form[:-1] + chr(ord(form[-1]) - FINAL))]

    def _holds(self, key: int) -> bool:
        a, b = key >> 20, (key & 0xFFFFF) - 1
        return self.merge_pair(self.text[a] + (self.text[b] if b >= 0 else "")) == ([a, b] if b >= 0 else [a])

    def encode_pieces(self, forms: list[str]) -> dict[str, list[int]]:
        """Ids of distinct pieces (in their shifted form)."""
        if not forms:
            return {}
        found = list(self.trie.iter_long("".join(forms)))
        ends = np.array([e for e, _ in found], np.int64) + 1
        a = np.array([i for _, i in found], np.int64)
        sizes = np.array([len(f) for f in forms])
        stop = np.cumsum(sizes)
        edges = np.r_[np.searchsorted(ends, stop - sizes, "right"), len(a)]
        begins = ends - self.length[a]
        # whole: the proposed tokens lie side by side from the piece's first character to its last
        tiles = np.r_[begins == np.r_[0, ends[:-1]], True]
        whole = (np.minimum.reduceat(tiles, edges[:-1]) if len(a) else np.zeros(len(forms), bool)) & (edges[1:] > edges[:-1])
        whole &= np.r_[ends, 0][edges[1:] - 1] == stop
        last = np.zeros(len(a), bool)
        last[edges[1:][edges[1:] > edges[:-1]] - 1] = True
        single = np.zeros(len(a), bool)
        single[edges[:-1][np.diff(edges) == 1]] = True
        key = a << 20
        key[:-1] |= np.where(last[:-1], 0, a[1:] + 1)
        asked = ~last | single
        distinct, place = np.unique(key[asked], return_inverse=True)
        known = self.pairs
        for k in distinct.tolist():
            if k not in known:
                known[k] = self._holds(k)
        fails = np.zeros(len(a) + 1, np.int64)
        fails[:-1][asked] = ~np.array([known[k] for k in distinct.tolist()], bool)[place]
        sums = np.r_[0, np.cumsum(fails)]
        holds = whole & (sums[edges[1:]] == sums[edges[:-1]])
        ids, at = a.tolist(), edges.tolist()
        return {f: ids[x:y] if ok else self.merge_piece(f) for f, ok, x, y in zip(forms, holds.tolist(), at[:-1], at[1:], strict=True)}

    def _cut(self, words: list[str]) -> list[list[str]]:
        """Pieces of each word, in shifted form."""
        out: list[list[str]] = [[] for _ in words]
        fast = LATIN.fullmatch
        latin = [i for i, w in enumerate(words) if fast(w)]
        shifted: dict[str, str] = {}
        if latin:
            at, now = iter(latin), []
            for p in PIECES.findall(" ".join([words[i] for i in latin]).lower()):
                if p == " ":
                    out[next(at)], now = now, []
                    continue
                f = shifted.get(p)
                if f is None:
                    f = shifted[p] = _shift_last(p if p.isascii() else p.encode().decode("latin-1").translate(_BYTE_NAMES))
                now.append(f)
            out[next(at)] = now
        for i in set(range(len(words))).difference(latin):
            out[i] = [_shift_last(p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(words[i]))]
        return out

    def learn(self, words: list[bytes]) -> None:
        """Encodes new words (split at ASCII white space, lower-cased if they hold no special token)."""
        texts = [w.decode() for w in words]
        marked = {n: [x for x in self.split_special.split(t) if x] for n, t in enumerate(texts) if "<|" in t} if self.split_special else {}
        plain = [t for n, t in enumerate(texts) if n not in marked] + [x for t in marked.values() for x in t if x not in self.special]
        cut = self._cut(plain)
        encoded = self.encode_pieces(list(dict.fromkeys(f for c in cut for f in c)))
        number, name = self.number, self.name
        ready = {f: (len(i), " ".join([number[x] for x in i]), " ".join([name[x] for x in i])) for f, i in encoded.items()}
        each = iter(cut[: len(plain)])
        rest = iter(cut[len(texts) - len(marked) :])
        for n, w in enumerate(words):
            if n in marked:
                own = []
                for x in marked[n]:
                    own += [(1, number[self.special[x]], x)] if x in self.special else [ready[f] for f in next(rest)]
            else:
                own = [ready[f] for f in next(each)]
            self.words[w] = len(self.counts)
            if len(own) == 1:
                k, i, t = own[0]
            else:
                k, i, t = sum([o[0] for o in own]), " ".join([o[1] for o in own]), " ".join([o[2] for o in own])
            self.counts.append(k)
            self.ids.append(i)
            self.back.append(t)
        self.used = np.r_[self.used, np.zeros(len(words), np.int64)]

    def words_of(self, raw: bytes) -> list[bytes]:
        if b"<|" not in raw:
            return raw.lower().split()
        return [w if b"<|" in w else w.lower() for w in raw.split()]

    def run(self, texts: list[bytes]) -> tuple[list[int], list[str], list[str]]:
        """Number of ids, ids as decimal text, and decoded text of each text."""
        if len(self.words) > MEMORY_WORDS:
            self.forget()
        split = [self.words_of(t) for t in texts]
        at = self.words
        new = {w for ws in split for w in ws if w not in at}
        if new:
            self.learn(sorted(new))
        n, ids, back = [], [], []
        counts, text_ids, text_back = self.counts, self.ids, self.back
        seen = []
        for ws in split:
            k = [at[w] for w in ws]
            seen += k
            size = [counts[i] for i in k]
            if 0 in size:
                k = [i for i in k if counts[i]]
            n.append(sum(size))
            ids.append(" ".join([text_ids[i] for i in k]))
            back.append(" ".join([text_back[i] for i in k]))
        self.used += np.bincount(np.array(seen, np.int64), minlength=len(counts))
        return n, ids, back


_LOADED: dict[str, WordBpe] = {}


def loaded(spec: str) -> WordBpe:
    if spec not in _LOADED:
        _LOADED.clear()
        _LOADED[spec] = WordBpe(spec)
    return _LOADED[spec]


def encode_decode(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """Adds n_tokens, ids (decimal, joined by one space) and decoded to the rows of docs."""
    spark = docs.sparkSession
    shared.tune(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    added = ("n_tokens", "ids", "decoded")
    kept = [c for c in docs.columns if c not in added]
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch in batches:
            data, off = column_bytes(batch.column(at))
            for lo, hi in parts(off, 1 << 20):
                raw = data[off[lo] : off[hi]].tobytes()
                cut = (off[lo : hi + 1] - off[lo]).tolist()
                n, ids, back = bpe.run([raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)])
                own = batch.slice(lo, hi - lo)
                columns = {c: own.column(i) for i, c in enumerate(kept)} | {"n_tokens": pa.array(n, pa.int64()), "ids": pa.array(ids, pa.string()), "decoded": pa.array(back, pa.string())}
                yield pa.RecordBatch.from_pydict(columns)

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", n_tokens long, ids string, decoded string"
    return shared.pick(docs, *kept).mapInArrow(run, schema)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_bpe_encode_decode(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(encode_decode(docs, tokenizer_file("word_bpe_49k.json")))


QUERIES = {"op9_bpe_encode_decode": op9_bpe_encode_decode}
ORACLE: dict[str, str] = {}
