"""Similarity of many pairs of normalised names at once, in numpy.

A normalised name holds a-z and 0-9 only, so where each of its letters stands fits a
64-bit number a letter, and a pair of names takes a few operations a letter for all
pairs together.  Equal to the expressions of ``merchant`` to the last bit; names of
more than 64 letters are compared one by one.
"""

from __future__ import annotations

import numpy as np

from .merchant import CONTAINED, jaro_winkler

LETTERS, WIDTH = 36, 64
_ONE = np.uint64(1)
_CODE = np.zeros(256, np.uint8)
for _k, _c in enumerate(b"abcdefghijklmnopqrstuvwxyz0123456789"):
    _CODE[_c] = _k
#: Bits from i - reach to i + reach, by i and reach.
_REACH = np.array([[sum(1 << j for j in range(max(0, i - r), min(WIDTH, i + r + 1))) for r in range(WIDTH // 2)] for i in range(WIDTH)], np.uint64)


class Names:
    """Distinct names with their letters (code), the places of every letter (at) and bits of their first three occurrences (bag)."""

    def __init__(self, names: list[str]):
        self.text = names
        self.length = np.array([len(x) for x in names], np.int64)
        n = len(names)
        raw = np.array([x.encode()[:WIDTH] for x in names] or [b""], f"S{WIDTH}").view(np.uint8).reshape(-1, WIDTH)[:n]
        self.code = _CODE[raw]
        self.head = np.where(np.arange(4) < self.length[:, None], raw[:, :4], 0)
        self.at = np.zeros((n, LETTERS), np.uint64)
        self.bag = np.zeros((2, n), np.uint64)
        seen = np.zeros((n, LETTERS), np.int64)
        for k in range(min(WIDTH, int(self.length.max(initial=0)))):
            rows = np.flatnonzero(self.length > k)
            c = self.code[rows, k].astype(np.int64)
            self.at[rows, c] |= _ONE << np.uint64(k)
            bit = seen[rows, c] * LETTERS + c
            seen[rows, c] += 1
            for half in (0, 1):
                mine = (bit >= half * 64) & (bit < min(half * 64 + 64, 3 * LETTERS))
                self.bag[half, rows[mine]] |= _ONE << (bit[mine] - half * 64).astype(np.uint64)
        self.more = np.maximum(seen - 3, 0).sum(axis=1)
        self.at = self.at.ravel()


def scores(a: Names, b: Names, i: np.ndarray, j: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Overlap, containment or Jaro-Winkler of names ``i`` of a and ``j`` of b, whichever is most; 0 where one is empty.

    Scores below ``need`` may come out less than they are.
    """
    out = np.zeros(len(i))
    la, lb = a.length[i], b.length[j]
    live = np.flatnonzero((la > 0) & (lb > 0))
    i, j, la, lb, need = i[live], j[live], la[live], lb[live], need[live]
    long = np.maximum(la, lb) > WIDTH
    one, two = a.bag[:, i], b.bag[:, j]
    a_in_b = ~((one & ~two).any(axis=0)) & (la <= lb) | long
    b_in_a = ~((two & ~one).any(axis=0)) & (lb <= la) | long
    score = np.zeros(len(i))
    for k in np.flatnonzero(a_in_b | b_in_a):
        x, y = a.text[i[k]], b.text[j[k]]
        if x in y or y in x:
            score[k] = 1.0 if x == y or min(len(x), len(y)) >= 3 else CONTAINED
    common = np.bitwise_count(one & two).sum(axis=0, dtype=np.int64) + np.minimum(a.more[i], b.more[j])
    same = np.logical_and.accumulate((a.head[i] == b.head[j]) & (a.head[i] != 0), axis=1).sum(axis=1)
    at_most = np.minimum(common, np.minimum(la, lb))
    best = _winkler((at_most / la + at_most / lb + 1.0) / 3, same)
    open_ = np.flatnonzero((score < 1.0) & (best >= need) & (at_most > 0) & ~long)
    score[open_] = np.maximum(score[open_], _jaro_winkler(a, b, i[open_], j[open_], la[open_], lb[open_], same[open_]))
    for k in np.flatnonzero(long & (score < 1.0)):
        score[k] = max(score[k], jaro_winkler(a.text[i[k]], b.text[j[k]]))
    out[live] = score
    return out


def _winkler(jaro: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    return jaro + prefix * 0.1 * (1 - jaro)


def _jaro_winkler(a: Names, b: Names, i: np.ndarray, j: np.ndarray, la: np.ndarray, lb: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    order = np.argsort(-la, kind="stable")  # pairs whose first name has ended are a tail
    i, j, la, lb, prefix = i[order], j[order], la[order], lb[order], prefix[order]
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    row, free = j * LETTERS, np.full(len(i), 2**64 - 1, np.uint64)
    ends = np.searchsorted(-la, -np.arange(int(la.max(initial=0))), "left")
    hits = []
    for k, n in enumerate(ends):
        found = b.at[row[:n] + a.code[i[:n], k]] & _REACH[k][reach[:n]] & free[:n]
        low = found & (~found + _ONE)
        free[:n] ^= low
        hits.append(low != 0)
    rest = ~free
    m = np.bitwise_count(rest).astype(np.int64)
    apart = np.zeros(len(i), np.int64)
    for k, n in enumerate(ends):
        low = rest[:n] & (~rest[:n] + _ONE)
        apart[:n] += hits[k] & ((b.at[row[:n] + a.code[i[:n], k]] & low) == 0)
        rest[:n] ^= np.where(hits[k], low, np.uint64(0))
    whole = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / la + m / lb + (m - apart / 2) / whole) / 3, 0.0)
    out = np.empty(len(i))
    out[order] = np.where(m > 0, _winkler(jaro, prefix), 0.0)
    return out
