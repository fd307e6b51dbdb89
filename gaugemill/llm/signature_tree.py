"""Signature trees over sets: nodes hold OR-combined bitmaps and size ranges; two trees are walked
together and pairs of nodes that cannot hold a similar pair are dropped."""

from __future__ import annotations

import numpy as np

FANOUT = 8
WORDS = 16  # 64-bit words of a bitmap
_U = np.uint64


def bitmaps(tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One bit of 64 * WORDS for each token, OR-combined over each set (none is empty)."""
    bit = (tokens * _U(0x9E3779B97F4A7C15)) >> _U(54)
    one = np.zeros((len(tokens), WORDS), _U)
    one[np.arange(len(tokens)), (bit >> _U(6)).astype(np.int64) % WORDS] = _U(1) << (bit & _U(63))
    return np.bitwise_or.reduceat(one, starts, axis=0)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


class SignatureTree:
    """Levels from the sets themselves up to one root. For each node: the OR of its bitmaps, the least
    and greatest set size, and the greatest number of tokens that a set below has beyond its bits."""

    def __init__(self, sigs: np.ndarray, sizes: np.ndarray, shared: np.ndarray):
        self.levels = [(sigs, sizes, sizes, shared - _bits(sigs))]
        while len(self.levels[-1][0]) > 1:
            s, low, high, over = self.levels[-1]
            at = np.arange(0, len(s), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(s, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(over, at)))

    def possible(self, other: SignatureTree, level: int, other_level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether nodes i of self and j of other may hold a pair with overlap / union >= percent / 100.

        A set below i shares at most over + popcount(common bits) tokens with any set below j: each
        shared token sets a common bit, and a set has at most ``over`` tokens more than bits.
        """
        s, low, high, over = self.levels[level]
        t, low_, high_, over_ = other.levels[other_level]
        common = _bits(s[i] & t[j])
        most = np.minimum(np.minimum(over[i], over_[j]) + common, np.minimum(high[i], high_[j]))
        sizes = (100 * high[i] >= percent * low_[j]) & (100 * high_[j] >= percent * low[i])
        return sizes & ((100 + percent) * most >= percent * (low[i] + low_[j]))


def candidate_pairs(a: SignatureTree, b: SignatureTree | None, percent: int, chunk: int = 1 << 18):
    """Pairs of sets (i of ``a``, j of ``b``) that the bitmaps cannot rule out; with ``b`` None, pairs
    i < j inside ``a``. Node pairs are expanded depth first in chunks, so memory stays bounded."""
    other = a if b is None else b
    top = max(len(a.levels), len(other.levels)) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        la, lb = min(level, len(a.levels) - 1), min(level, len(other.levels) - 1)
        if b is None and level == 0:
            keep = i < j
            i, j = i[keep], j[keep]
        keep = a.possible(other, la, lb, i, j, percent)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if level == 0:
            yield i, j
            continue
        grow = lambda x, n, deep: (x[:, None] * FANOUT + np.arange(FANOUT) if deep else x[:, None], n)
        x, nx = grow(i, len(a.levels[la - 1][0]) if la == level else 0, la == level)
        y, ny = grow(j, len(other.levels[lb - 1][0]) if lb == level else 0, lb == level)
        p, q = np.broadcast_arrays(x[:, :, None], y[:, None, :])
        p, q = p.reshape(-1), q.reshape(-1)
        ok = np.ones(len(p), bool)
        if la == level:
            ok &= p < nx
        if lb == level:
            ok &= q < ny
        if b is None:
            ok &= p <= q
        p, q = p[ok], q[ok]
        stack += [(level - 1, p[k : k + chunk], q[k : k + chunk]) for k in range(0, len(p), chunk)]


def similar_pairs(tokens: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with 100 * overlap >= percent * union among sets given by the part of their tokens that
    other sets may have (``tokens``) and their full ``sizes``. ``side`` is 0 or 1: with both present,
    only pairs across are wanted; otherwise pairs inside."""
    # Sets of like size and like least token stand together, which keeps the nodes' bitmaps thin.
    least = np.array([t.min() for t in tokens])
    out_i, out_j = [], []
    groups = [np.flatnonzero(side == s) for s in (0, 1)]
    groups = [g[np.lexsort((sizes[g], least[g]))] for g in groups if len(g)]
    flat = np.concatenate(tokens)
    begin = np.concatenate(([0], np.cumsum([len(t) for t in tokens])[:-1]))
    sigs = bitmaps(flat, begin)
    length = np.array([len(t) for t in tokens])
    trees = [SignatureTree(sigs[g], sizes[g], length[g]) for g in groups]
    exact = None
    for i, j in candidate_pairs(trees[0], trees[1] if len(trees) > 1 else None, percent):
        if exact is None:
            # Exact bitmaps over the tokens that at least two sets here have; the rest overlaps with nothing.
            _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
            local = np.cumsum(n > 1) - 1
            keep = n[at] > 1
            owner, bit = np.repeat(np.arange(len(tokens)), length)[keep], local[at[keep]]
            exact = np.zeros((len(tokens), int((n > 1).sum()) // 64 + 1), _U)
            np.bitwise_or.at(exact, (owner, bit >> 6), _U(1) << (bit & 63).astype(_U))
        step = max(1, (1 << 21) // exact.shape[1])
        for k in range(0, len(i), step):
            x, y = groups[0][i[k : k + step]], groups[-1][j[k : k + step]]
            both = _bits(exact[x] & exact[y])
            hit = 100 * both >= percent * (sizes[x] + sizes[y] - both)
            out_i.append(x[hit])
            out_j.append(y[hit])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(out_i or none), np.concatenate(out_j or none)


def spanning_links(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member reachable) for members other than that one."""
    label = np.arange(n)
    while True:
        new = label.copy()
        m = np.minimum(label[i], label[j])
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]
