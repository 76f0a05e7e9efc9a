"""Cheapest edits of many role sequences at once, with ties settled by the least audit string.

All lanes (a lane is a sequence of rows and the state in which it is entered) advance row by row together. A state's best edits are one
node of a persistent tree: a letter and the parent that it continues, so prefixes are shared and never copied. Nodes carry a rolling hash and
binary-lifting ancestors; of two equally cheap strings the first place where they differ is found by lifting both as long as their
hashes differ. What the hashes call equal is then verified letter by letter, up to the node that both share.

Edits before a row belong to the row: strings end with the letter of a row. So no string over the same rows is a prefix of another, the order
of two strings never depends on what follows, and stretches of one sequence can be solved apart and chained.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
#: States: nothing yet, after s, after u, after a. Costs: rows without a choice are as long as INF apart.
START, SYSTEM, USER, ASSISTANT = range(4)
INF = np.int64(1 << 60)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
D, I, K, R = (ord(c) for c in "DIKR")
#: Cost of the insertions that make each state an end, and the roles that they insert.
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
END_ROLES = ((), ("user", "assistant"), ("assistant",), ())
#: Codes of role initials; all others are OTHER.
INITIALS, OTHER = {"s": 0, "u": 1, "a": 2}, 3


class Tree:
    """Strings as nodes; node 0 is the empty string."""

    def __init__(self, depth: int):
        self.n, self.levels = 1, max(1, int(depth).bit_length())
        self.letter, self.depth, self.hash = np.zeros(1024, np.uint8), np.zeros(1024, np.int32), np.zeros(1024, U64)
        self.up = np.zeros((self.levels, 1024), np.int32)

    def add(self, parent: np.ndarray, letter) -> np.ndarray:
        n, m = self.n, self.n + len(parent)
        if m > len(self.letter):
            more = max(m, 2 * len(self.letter)) - len(self.letter)
            self.letter, self.depth, self.hash = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.letter, self.depth, self.hash))
            self.up = np.concatenate([self.up, np.zeros((self.levels, more), np.int32)], axis=1)
        self.letter[n:m], self.depth[n:m] = letter, self.depth[parent] + 1
        self.hash[n:m] = self.hash[parent] * _BASE + self.letter[n:m]
        self.up[0, n:m] = parent
        for k in range(1, self.levels):
            self.up[k, n:m] = self.up[k - 1, self.up[k - 1, n:m]]
        self.n = m
        return np.arange(n, m, dtype=np.int32)

    def _lifted(self, x: np.ndarray, by: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            x = np.where(by >> k & 1, self.up[k, x], x)
        return x

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which strings a are less than b; a proper prefix is less."""
        gap = self.depth[a] - self.depth[b]
        x, y = self._lifted(a, np.maximum(gap, 0)), self._lifted(b, np.maximum(-gap, 0))
        same = self.hash[x] == self.hash[y]
        for k in reversed(range(self.levels)):
            above, beside = self.up[k, x], self.up[k, y]
            go = self.hash[above] != self.hash[beside]
            x, y = np.where(go, above, x), np.where(go, beside, y)
        out = np.where(same, gap < 0, self.letter[x] < self.letter[y])
        # the hashes found equal what lies above; letters decide, and an earlier difference counts
        x, y = np.where(same, x, self.up[0, x]), np.where(same, y, self.up[0, y])
        left = np.flatnonzero(x != y)
        while len(left):
            p, q = self.letter[x[left]], self.letter[y[left]]
            out[left] = np.where(p == q, out[left], p < q)
            x[left], y[left] = self.up[0, x[left]], self.up[0, y[left]]
            left = left[x[left] != y[left]]
        return out

    def best(self, *choices: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Cost and node of the best of (cost, node, letter or None) for each lane."""
        low = np.minimum.reduce([c for c, _, _ in choices])
        out = np.zeros(len(low), np.int32)
        none = np.ones(len(low), bool)
        for cost, node, letter in choices:
            at = np.flatnonzero((cost == low) & (low < INF))
            if not len(at):
                continue
            new = node[at] if letter is None else self.add(node[at], letter if np.isscalar(letter) else letter[at])
            take = none[at]
            tied = np.flatnonzero(~take)
            if len(tied):
                take[tied] = self.less(new[tied], out[at[tied]])
            out[at[take]] = new[take]
            none[at] = False
        return low, out

    def strings(self, nodes: np.ndarray) -> list[str]:
        size = self.depth[nodes].astype(np.int64)
        first = np.cumsum(size) - size
        flat, x = np.zeros(int(size.sum()), np.uint8), nodes.copy()
        left = np.flatnonzero(size)
        while len(left):
            flat[first[left] + self.depth[x[left]] - 1] = self.letter[x[left]]
            x[left] = self.up[0, x[left]]
            left = left[self.depth[x[left]] > 0]
        body = flat.tobytes().decode()
        return [body[a : a + n] for a, n in zip(first.tolist(), size.tolist(), strict=True)]


def solve(code: np.ndarray, must: np.ndarray, cut: np.ndarray, begin: np.ndarray, size: np.ndarray, entry: np.ndarray) -> tuple[Tree, np.ndarray, np.ndarray]:
    """For lanes of rows begin to begin + size, entered in entry: the tree, and cost and node by lane and last state. code: role initials; must: rows that have to go; cut: truncated rows."""
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    longest = int(size[0]) if len(size) else 0
    tree = Tree(3 * longest + 3)
    cost, node = np.full((4, len(size)), INF), np.zeros((4, len(size)), np.int32)
    cost[entry[order], np.arange(len(size))] = 0
    for step in range(longest):
        m = int(np.searchsorted(-size, -step, "left"))  # lanes that are longer than step
        row = begin[:m] + step
        c, n = [cost[s, :m] for s in range(4)], [node[s, :m] for s in range(4)]
        # insertions before the row
        c[USER], n[USER] = tree.best((c[USER], n[USER], None), *[(c[s] + INSERT, n[s], I) for s in (START, SYSTEM, ASSISTANT)])
        c[ASSISTANT], n[ASSISTANT] = tree.best((c[ASSISTANT], n[ASSISTANT], None), (c[USER] + INSERT, n[USER], I))
        stays = np.where(must[row], INF, np.where(cut[row], TRUNCATED, 0))
        kind = code[row]

        def turned(s: int, to: int) -> tuple:
            own = kind == to  # noqa: B023
            return np.minimum(c[s] + stays + np.where(own, 0, REROLE), INF), n[s], np.where(own, K, R).astype(np.uint8)  # noqa: B023

        gone = [(np.minimum(c[s] + DELETE, INF), n[s], D) for s in range(4)]
        system = (np.where(kind == 0, np.minimum(c[START] + stays, INF), INF), n[START], K)
        new = (tree.best(gone[START]), tree.best(gone[SYSTEM], system), tree.best(gone[USER], *[turned(s, 1) for s in (START, SYSTEM, ASSISTANT)]), tree.best(gone[ASSISTANT], turned(USER, 2)))
        for s in range(4):
            cost[s, :m], node[s, :m] = new[s]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return tree, cost[:, back].T.copy(), node[:, back].T.copy()


def chosen(tree: Tree, total: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The last state of each lane with the least total, ties to the least string."""
    at = np.arange(len(total))
    out = np.zeros(len(total), np.int64)
    for s in range(1, 4):
        old = total[at, out]
        better = total[:, s] < old
        tied = np.flatnonzero((total[:, s] == old) & (old < INF))
        if len(tied):
            better[tied] = tree.less(node[tied, s], node[tied, out[tied]])
        out[better] = s
    return out


def ranks(tree: Tree, node: np.ndarray) -> np.ndarray:
    """The place of each lane's four strings in their order."""
    out = np.zeros(node.shape, np.int64)
    for a in range(4):
        for b in range(4):
            if a != b:
                out[:, a] += tree.less(node[:, b], node[:, a])
    return out


def edited(letters: str, rows: list[tuple[str, str]], state: int) -> list[tuple[str, str]]:
    """The rows (role, text) after the edits, for a stretch entered in state."""
    out, at = [], iter(rows)
    for x in letters:
        if x == "D":
            next(at)
            continue
        role, text = ("", "") if x == "I" else next(at)
        if x != "K":
            role = "assistant" if state == USER else "user"
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        out.append((role, text))
    return out
