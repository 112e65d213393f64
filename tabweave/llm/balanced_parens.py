"""An ordered tree as balanced parentheses with excess minima by block: where subtrees end, and how many leaves lie before a place.

Nodes are numbered in preorder. All questions are asked for many nodes at a time.
"""

from __future__ import annotations

import numpy as np

BLOCK = 64
#: Rows of blocks that are looked at in one go.
_SLICE = 1 << 14


class Minima:
    """Minima over aligned runs of an array, each twice as long as those below."""

    def __init__(self, values: np.ndarray, most: int) -> None:
        self.width = 1 << max(0, int(len(values) - 1).bit_length())
        self.tree = np.full(2 * self.width, most, np.int64)
        self.tree[self.width : self.width + len(values)] = values
        level = self.width
        while level > 1:
            half = level // 2
            self.tree[half:level] = np.minimum(self.tree[level : 2 * level : 2], self.tree[level + 1 : 2 * level : 2])
            level = half

    def least(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The least value from begin up to end, which is greater."""
        a, b = begin + self.width, end + self.width
        out = np.full(len(a), np.iinfo(np.int64).max)
        while (open_ := a < b).any():
            left, right = open_ & (a & 1 == 1), open_ & (b & 1 == 1)
            out[left] = np.minimum(out[left], self.tree[a[left]])
            out[right] = np.minimum(out[right], self.tree[b[right] - 1])
            a, b = (a + left) >> 1, (b - right) >> 1
        return out

    def next_at_most(self, after: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place behind `after` whose value is at most the bound; there is one."""
        node, going = after + self.width, np.ones(len(after), bool)
        while going.any():
            hit = going & (node & 1 == 0) & (self.tree[np.minimum(node + 1, len(self.tree) - 1)] <= bound)
            node = np.where(hit, node + 1, np.where(going, node >> 1, node))
            going &= ~hit
        while (inner := node < self.width).any():
            left = 2 * node
            down = np.where(self.tree[np.where(inner, left, 1)] <= bound, left, left + 1)
            node = np.where(inner, down, node)
        return node - self.width


class Parentheses:
    """The tree whose nodes have these depths in preorder; the first is the root, of depth 0."""

    def __init__(self, depths: np.ndarray) -> None:
        n = len(depths)
        self.opens = 2 * np.arange(n) - depths  # a node's parenthesis stands behind those of the nodes before it and of the subtrees that have ended
        bits = np.zeros(2 * n, np.int8)
        bits[self.opens] = 1
        excess = np.cumsum(2 * bits.astype(np.int64) - 1)
        blocks = -(-2 * n // BLOCK)
        self.excess = np.full((blocks, BLOCK), 2 * n, np.int64)
        self.excess.reshape(-1)[: 2 * n] = excess
        self.minima = Minima(self.excess.min(axis=1), 2 * n)
        self.leaves = np.concatenate([[0], np.cumsum((bits[:-1] == 1) & (bits[1:] == 0))])  # pairs `()` that begin before a place
        self.depths = depths

    def find_close(self) -> np.ndarray:
        """Where each node's closing parenthesis stands: the first place behind its own of one less excess."""
        out = np.empty(len(self.opens), np.int64)
        for at in range(0, len(out), _SLICE):
            opens, bound = self.opens[at : at + _SLICE], self.depths[at : at + _SLICE]
            block = opens // BLOCK
            inside = (self.excess[block] <= bound[:, None]) & (np.arange(BLOCK) > (opens % BLOCK)[:, None])
            there = inside.any(axis=1)
            found = block * BLOCK + inside.argmax(axis=1)
            if not there.all():
                later = self.minima.next_at_most(block[~there], bound[~there])
                found[~there] = later * BLOCK + (self.excess[later] <= bound[~there][:, None]).argmax(axis=1)
            out[at : at + _SLICE] = found
        return out

    def leaves_within(self, closes: np.ndarray) -> np.ndarray:
        """Leaves of each subtree, by the ranks of its two parentheses among pairs."""
        return self.leaves[closes] - self.leaves[self.opens]
