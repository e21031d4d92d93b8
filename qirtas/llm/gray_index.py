"""Hierarchical index over bit fingerprints in Gray order, for joins by Hamming distance.

Fingerprints are sorted by Gray rank, so that neighbours share long bit patterns. A node covers a run of the sorted list
and holds the bits on which all its members agree (mask and pattern); what its parent's mask already fixes is not compared
again. Two nodes are compared from the root down: the differences on bits fixed in both add up, and the whole pair of
groups is dropped once the sum exceeds the threshold.
"""

from __future__ import annotations

import numpy as np

LEAF, FAN = 8, 4


def gray_rank(bits: np.ndarray) -> list[np.ndarray]:
    """Position in the reflected Gray code of each (n, words) uint64 fingerprint, as words from the highest on."""
    ranks, odd = [], np.zeros(len(bits), dtype=bool)
    for k in range(bits.shape[1]):
        x = bits[:, k].copy()
        for s in (1, 2, 4, 8, 16, 32):
            x ^= x >> np.uint64(s)
        ranks.append(np.where(odd, ~x, x))
        odd ^= (np.bitwise_count(bits[:, k]) & 1).astype(bool)
    return ranks


def gray_code(rank: np.ndarray) -> np.ndarray:
    """The uint64 code at each position of the reflected Gray code."""
    return rank ^ (rank >> np.uint64(1))


def near_pairs(bits: np.ndarray, most: int, same: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs (i, j), i before j in Gray order, with a Hamming distance of at most `most`. bits: (n, words) uint64.

    same: (n, words) leading bits in which no difference is allowed. They head the order, and one difference on them counts
    for more than `most`, so nodes of other leading bits are dropped at the first level that fixes them.
    """
    n = len(bits)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    lead = 0 if same is None else same.shape[1]
    bits = bits if same is None else np.concatenate([same, bits], 1)
    weight = np.array([most + 1] * lead + [1] * (bits.shape[1] - lead), dtype=np.int64)
    order = np.lexsort(gray_rank(bits)[::-1])
    ranked = bits[order]
    # Levels from the leaves up: [first, last) of each node, its mask and its pattern.
    edges = np.arange(0, n, LEAF)
    conj, disj = np.bitwise_and.reduceat(ranked, edges), np.bitwise_or.reduceat(ranked, edges)
    levels = [(~(conj ^ disj), conj)]
    while len(levels[-1][0]) > 1:
        up = np.arange(0, len(conj), FAN)
        conj, disj = np.bitwise_and.reduceat(conj, up), np.bitwise_or.reduceat(disj, up)
        levels.append((~(conj ^ disj), conj))
    a = b = np.zeros(1, np.int64)
    mask, pattern = levels[-1]
    fixed = mask[a] & mask[b]
    acc = np.zeros(1, np.int64)
    step_a, step_b = np.divmod(np.arange(FAN * FAN), FAN)
    for mask, pattern in reversed(levels[:-1]):
        ca, cb = (a[:, None] * FAN + step_a).ravel(), (b[:, None] * FAN + step_b).ravel()
        parent = np.repeat(np.arange(len(a)), FAN * FAN)
        ok = (ca <= cb) & (cb < len(mask))
        ca, cb, parent = ca[ok], cb[ok], parent[ok]
        both = mask[ca] & mask[cb]
        new = both & ~fixed[parent]
        grown = acc[parent] + np.bitwise_count((pattern[ca] ^ pattern[cb]) & new).astype(np.int64) @ weight
        keep = grown <= most
        a, b, fixed, acc = ca[keep], cb[keep], both[keep], grown[keep]
    left, right = [], []
    grid_a, grid_b = (g.ravel() for g in np.meshgrid(np.arange(LEAF), np.arange(LEAF), indexing="ij"))
    for at in range(0, len(a), 8000):
        i, j = (a[at : at + 8000, None] * LEAF + grid_a).ravel(), (b[at : at + 8000, None] * LEAF + grid_b).ravel()
        ok = (i < j) & (j < n)
        i, j = i[ok], j[ok]
        if lead:
            ok = (ranked[i, :lead] == ranked[j, :lead]).all(1)
            i, j = i[ok], j[ok]
        near = np.bitwise_count(ranked[i, lead:] ^ ranked[j, lead:]).sum(1, dtype=np.int64) <= most
        left.append(i[near]), right.append(j[near])
    return order[np.concatenate(left)], order[np.concatenate(right)]
