"""Byte-pair merging of many pre-tokens at once: in every round each unfinished pre-token merges its pair of lowest rank."""

from __future__ import annotations

import numpy as np

from .textcore import U64
from .wordbpe import byte_names

#: Rank of pairs that no rule merges.
NONE = np.int64(1 << 40)
_SLOT_BITS = 19
_MULT = U64(0x9E3779B97F4A7C15)


class PairMerges:
    """The rules of a byte-level BPE model without options, over ids below 65,536."""

    def __init__(self, model: dict):
        vocab, names = model["vocab"], byte_names()
        options = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        #: Whether the rules alone decide; if not, ids() must not be used.
        self.alone = model.get("type", "BPE") == "BPE" and not any(model.get(o) for o in options) and all(names[b] in vocab for b in range(256))
        if not self.alone:
            return
        self.first = np.array([vocab[names[b]] for b in range(256)], U64)
        rules = [r.split(" ") if isinstance(r, str) else r for r in model["merges"]]
        self.made = np.array([vocab[a + b] for a, b in rules], U64)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in rules], U64)
        # open addressing; a slot holds a key, the empty one 1 << 32
        self.keys, self.ranks = np.full(1 << _SLOT_BITS, 1 << 32, U64), np.zeros(1 << _SLOT_BITS, np.int64)
        left = np.arange(len(keys))
        at = self._slot(keys)
        while len(left):
            free = self.keys[at[left]] == U64(1 << 32)
            some = left[free]
            won = some[np.unique(at[some], return_index=True)[1]]
            self.keys[at[won]], self.ranks[at[won]] = keys[won], won
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << _SLOT_BITS) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MULT >> U64(64 - _SLOT_BITS)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the rule that merges a and b, or NONE."""
        keys = a << U64(16) | b
        at = self._slot(keys)
        out = np.full(len(keys), NONE)
        held = self.keys[at]
        hit = held == keys
        out[hit] = self.ranks[at[hit]]
        left = np.flatnonzero(~hit & (held != U64(1 << 32)))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << _SLOT_BITS) - 1)
            held = self.keys[at[left]]
            hit = held == keys[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (held != U64(1 << 32))]
        return out

    def ids(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens one after another, and the number of ids of each; size: bytes of each in raw (none is empty, all are below a megabyte)."""
        token = np.repeat(np.arange(len(size)), size)
        symbol = self.first[raw]
        rank = np.full(len(symbol), NONE)
        inner = np.flatnonzero(token[1:] == token[:-1])
        rank[inner] = self.rank(symbol[inner], symbol[inner + 1])
        done_token, done_symbol = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
        while len(symbol):
            begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            n = np.diff(np.r_[begin, len(symbol)])
            # lowest rank, then leftmost within the pre-token
            best = np.minimum.reduceat((rank << 20) + (np.arange(len(rank)) - np.repeat(begin, n)), begin)
            over = (best >> 20) >= NONE
            stays = np.repeat(~over, n)
            if over.any():
                done_token.append(token[~stays])
                done_symbol.append(symbol[~stays])
            at = (begin + (best & ((1 << 20) - 1)))[~over]
            symbol[at] = self.made[rank[at]]
            stays[at + 1] = False
            # the pair after the merged one belongs to the merged symbol now
            after = at[(at + 2 < len(symbol))]
            after = after[token[after + 2] == token[after]]
            rank[at] = NONE
            rank[after] = self.rank(symbol[after], symbol[after + 2])
            before = at[at > 0]
            before = before[token[before - 1] == token[before]]
            rank[before - 1] = self.rank(symbol[before - 1], symbol[before])
            token, symbol, rank = token[stays], symbol[stays], rank[stays]
        token, symbol = np.concatenate(done_token), np.concatenate(done_symbol)
        return symbol[np.argsort(token, kind="stable")].astype(np.uint16), np.bincount(token, minlength=len(size))
