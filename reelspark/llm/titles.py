"""Pairs of similar titles, met on arrays.

Titles that must agree in something come to one task with a token for it, and
meet there by keys: hashes of parts, halves or grams with the token in them.
A task holds the few keys of one side in order and looks up the many of the
other, some lengths at a time, so no key is ever shuffled or written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

from ..operators.blocks import spread

Q_JA, Q_EN = 3, 8
OVERLAP = 0.5
#: Least score of one title of an accepted pair, so at most a seventh of it is edited: below it lie titles that only look alike.
TITLE = 0.73
#: Longer titles are met by grams of GAP letters instead of parts, of which they would have too many.
LONG, GAP = 128, 3
#: Bits for the letters of a title in ``linkage.title_mark``.
LETTERS = 55
#: Keys formed and pairs judged at once, for the worker's memory.
CELLS = 1_000_000


def most_edits(longest: int) -> int:
    """The most edits at which ``_title_score`` still gives ``TITLE`` to texts of which the longer has this length."""
    by_ratio = int(longest * (1 - TITLE / 0.85) + 1e-9)
    return max(by_ratio, 2 if longest >= 8 else 1 if longest >= 4 else 0)


@lru_cache(maxsize=4096)
def _segments(m: int) -> np.ndarray:
    """(salt, start, length) of the parts a text of length ``m`` is cut into: one more than its edits, so one stays whole."""
    k = min(most_edits(m) + 1, m)
    return np.array([(m << 8 | i, i * m // k, (i + 1) * m // k - i * m // k) for i in range(k)], np.int64).T


@lru_cache(maxsize=4096)
def _places(n: int) -> np.ndarray:
    """(salt, position, length) at which parts of texts of length ``m`` may stand in a shorter one of length ``n``.

    A part is looked for only where it can lie if no earlier and no later part is whole (multi-match-aware
    positions of Pass-Join): at most i to either side from the left, and as many as parts follow from the right.
    """
    out, m = [], n
    while m <= LONG and m - n <= most_edits(m):
        most, gap = most_edits(m), n - m
        for i, (p, k) in enumerate(_segments(m)[1:].T.tolist()):
            left, right = i, most - i
            out += [(m << 8 | i, at, k) for at in range(max(0, p - left, p + gap - right), min(n - k, p + left, p + gap + right) + 1)]
        m += 1
    return np.array(out, np.int64).reshape(-1, 3).T


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread bits of an array of 64-bit numbers, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


class Texts:
    """Texts as sums of their letters' hashes, so any part is hashed by one subtraction."""

    def __init__(self, texts: list[str], token: np.ndarray | None = None, mark: np.ndarray | None = None, rare: list[bytes] | None = None) -> None:
        self.texts, self.token, self.mark, self.rare = texts, token, mark, rare
        self.n = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.start = np.cumsum(self.n) - self.n
        most = 1 << int(self.n.max(initial=1)).bit_length()
        self.back = _powers(_BACK, most)
        letters = _mixed(codes + np.uint64(1)) * _powers(_BASE, most)[np.arange(len(codes)) - np.repeat(self.start, self.n)]
        self.sums = np.r_[np.uint64(0), np.cumsum(letters)]
        self.two = None if token is None else self._two()

    def _two(self) -> np.ndarray:
        """The pairs of letters that follow each other, as 256 bits; several may share one."""
        out, some = np.zeros((len(self.n), 4), np.uint64), np.flatnonzero(self.n > 1)
        if len(some):
            row, at = self.windows(2, some)
            h = _mixed(self.part(row, at, np.full(len(at), 2)))
            bit, word = np.uint64(1) << (h >> np.uint64(58)), h & np.uint64(3)
            first = np.cumsum(self.n[some] - 1) - (self.n[some] - 1)
            for k in range(4):
                out[some, k] = np.bitwise_or.reduceat(np.where(word == k, bit, np.uint64(0)), first)
        return out

    def part(self, rows: np.ndarray, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Hashes of the parts of these rows from letter ``at``, ``k`` letters long."""
        i = self.start[rows] + at
        return (self.sums[i + k] - self.sums[i]) * self.back[at]

    def keys(self, rows: np.ndarray, at: np.ndarray, k: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return _mixed(self.part(rows, at, k) + _mixed(salt.astype(np.uint64) + np.uint64(_BASE)) + self.token[rows])

    def lengths(self, least: int = 1, most: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(length, rows as a column)."""
        order = np.argsort(self.n, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(self.n[order])) + 1):
            if len(rows) and self.n[rows[0]] >= least and (most is None or self.n[rows[0]] <= most):
                yield int(self.n[rows[0]]), rows[:, None]

    def windows(self, q: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, position) of the grams of ``q`` letters; a shorter text is one itself."""
        many = np.maximum(self.n[rows] - q + 1, 1)
        return np.repeat(rows, many), spread(np.zeros(len(rows), np.int64), many)

    def grams(self, q: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, position, hash) of the distinct grams of ``q`` letters of these rows, in order of rows and hashes."""
        row, at = self.windows(q, rows)
        h = _mixed(self.part(row, at, np.minimum(q, self.n[row])))
        order = np.lexsort((at, h, row))
        row, at, h = row[order], at[order], h[order]
        first = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])] if len(row) else np.zeros(0, bool)
        return row[first], at[first], h[first]


Few = tuple[np.ndarray, np.ndarray]  # rows and keys
Many = Iterator[tuple[np.ndarray, np.ndarray]]  # rows and keys, some at a time


def _by_length(t: Texts, of: Callable[[int], np.ndarray], salt: int, least: int, most: int | None) -> Many:
    for n, rows in t.lengths(least, most):
        s, at, k = of(n)
        if len(s):
            step = max(1, CELLS // len(s))
            for i in range(0, len(rows), step):
                some = rows[i : i + step]
                yield np.repeat(some[:, 0], len(s)), t.keys(some, at, k, s + (salt << 32)).ravel()


def _halves(n: int) -> np.ndarray:
    half = (n + 1) // 2
    return np.array([(0, 0, half), (1, half - 1, n - half + 1)], np.int64).T


def _ends(n: int) -> np.ndarray:
    """Both ends as long as halves of no longer texts."""
    return np.array([x for k in range(2, n // 2 + 2) for x in ((0, 0, k), (1, n - k, k))], np.int64).reshape(-1, 3).T


def _all(many: Many) -> Few:
    parts = list(many)
    return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _long_grams(t: Texts, few: bool) -> Few:
    """Each edit spoils GAP grams, so one of some more than that is left; the rarest here are taken."""
    row, _, h = t.grams(GAP, np.flatnonzero(t.n > LONG * TITLE / 0.85 - 1))
    if few and len(row):
        _, same, df = np.unique(h, return_inverse=True, return_counts=True)
        order = np.lexsort((df[same], row))
        row, h = row[order], h[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        near = place <= GAP * np.ceil(t.n[row] * (0.85 / TITLE - 1))
        row, h = row[near], h[near]
    return row, _mixed(h + t.token[row])


def _rare_grams(t: Texts, q: int) -> Few:
    """The grams marked in ``rare``, a bit a position."""
    size = np.fromiter(map(len, t.rare), np.int64, len(t.rare))
    bits = np.unpackbits(np.frombuffer(b"".join(t.rare), np.uint8))
    row, at = t.windows(q, np.flatnonzero(size))
    on = bits[8 * (np.cumsum(size) - size)[row] + at] > 0
    row, at = row[on], at[on]
    return row, _mixed(_mixed(t.part(row, at, np.minimum(q, t.n[row]))) + t.token[row])


_EDITS = np.array([max(int(n * (1 - TITLE / 0.85) + 1e-9), 2) for n in range(256)], np.int64)


def may_agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``linkage.may_agree`` of marks on arrays."""
    lx, ly = x >> LETTERS & 511, y >> LETTERS & 511
    both = (1 << LETTERS) - 1
    more, less = np.bitwise_count(x & ~y & both), np.bitwise_count(y & ~x & both)
    longest = np.maximum(lx, ly)
    edits = np.maximum(np.maximum(more, less), np.abs(lx - ly))
    return (longest == 255) | (edits <= _EDITS[longest]) | (lx <= ly) & (more == 0) | (ly <= lx) & (less == 0)


def may_be_near(x: Texts, f: np.ndarray, y: Texts, m: np.ndarray) -> np.ndarray:
    """Of pairs that ``may_agree``: False only if not. An edit spoils two pairs of letters at most; a shortened title has letters of the other only."""
    both = (1 << LETTERS) - 1
    one, two, lx, ly = x.mark[f], y.mark[m], x.n[f], y.n[m]
    u, v = x.two[f], y.two[m]
    spoiled = np.maximum(np.bitwise_count(u & ~v).sum(axis=1), np.bitwise_count(v & ~u).sum(axis=1))
    longest = np.maximum(lx, ly)
    gap = (lx <= ly) & (one & ~two & both == 0) | (ly <= lx) & (two & ~one & both == 0)
    return gap | (longest >= 255) | (spoiled <= 2 * _EDITS[np.minimum(longest, 255)])


def _meet(few: Few, many: Many, x: Texts, y: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of x, row of y) of equal keys whose marks may agree."""
    order = np.argsort(few[1])
    held = few[0][order]
    key, first, count = np.unique(few[1][order], return_index=True, return_counts=True)
    if not len(key):
        return
    shift = np.uint64(64 - min(24, max(12, len(key).bit_length() + 3)))
    known = np.zeros(1 << (64 - int(shift)), bool)
    known[key >> shift] = True
    for rows, keys in many:
        hit = np.flatnonzero(known[keys >> shift])
        at = np.minimum(np.searchsorted(key, keys[hit]), len(key) - 1)
        same = key[at] == keys[hit]
        at, r = at[same], rows[hit[same]]
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(np.cumsum(count[at]) // CELLS)) + 1):
            if len(part):
                k = count[at[part]]
                f, m = held[spread(first[at[part]], k)], np.repeat(r[part], k)
                near = may_agree(x.mark[f], y.mark[m])
                f, m = f[near], m[near]
                near = may_be_near(x, f, y, m)
                yield f[near], m[near]


def pairs(a: Texts, r: Texts, q: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of a, row of r) that share a token and may be similar: within edits, by one gap, or by a rare gram; none twice at a time."""
    codes: list[np.ndarray] = []

    def gather(found: Iterator[tuple[np.ndarray, np.ndarray]], turned: bool) -> None:
        held, size = [], 0
        for f, m in found:
            held.append(m * len(r.n) + f if turned else f * len(r.n) + m)
            size += len(f)
            if size > 4 * CELLS:
                held = [np.unique(np.concatenate(held))]
                size = 0
        codes.append(np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64))

    for x, y, turned in ((a, r, False), (r, a, True)):
        gather(_meet(_all(_by_length(x, _segments, 1, 1, LONG)), _by_length(y, _places, 1, 1, LONG), x, y), turned)
        gather(_meet(_all(_by_length(x, _halves, 2, 3, None)), _by_length(y, _ends, 2, 3, None), x, y), turned)
        gather(_meet(_long_grams(x, True), iter([_long_grams(y, False)]), x, y), turned)
    gather(_meet(_rare_grams(a, q), iter([_rare_grams(r, q)]), a, r), False)
    got = np.unique(np.concatenate(codes))
    for i in range(0, len(got), CELLS // 10):
        yield got[i : i + CELLS // 10] // len(r.n), got[i : i + CELLS // 10] % len(r.n)


def rare_bits(t: Texts, q: int, common: np.ndarray, times: np.ndarray, n: int) -> list[bytes]:
    """For each text, as bits, the first places of its rarest grams up to ``OVERLAP`` of their weight (all of a weight, if any).

    ``common``: grams in order that ``times`` titles have; others are in one.
    """
    row, at, h = t.grams(q, np.flatnonzero(t.n))
    df = np.ones(len(h), np.int64)
    if len(common) and len(h):
        i = np.minimum(np.searchsorted(common, h), len(common) - 1)
        df[common[i] == h] = times[i][common[i] == h]
    w = np.log(n / df) + 1e-6
    order = np.lexsort((df, row))
    row, at, w, df = row[order], at[order], w[order], df[order]
    sums = np.r_[0.0, np.cumsum(w)]
    first = np.searchsorted(row, row)
    total = sums[np.searchsorted(row, row, "right")] - sums[first]
    new = np.r_[True, (row[1:] != row[:-1]) | (df[1:] != df[:-1])] if len(row) else np.zeros(0, bool)
    before = sums[np.flatnonzero(new)[np.cumsum(new) - 1]] - sums[first] if len(row) else total
    rare = total - before >= OVERLAP * total - 1e-9 * np.maximum(1, total)
    size = np.where(t.n > 0, (np.maximum(t.n - q + 1, 1) + 7) // 8, 0)
    ends = np.cumsum(size)
    bits = np.zeros(8 * int(ends[-1]) if len(ends) else 0, np.uint8)
    bits[8 * (ends - size)[row[rare]] + at[rare]] = 1
    packed = np.packbits(bits).tobytes()
    return [packed[e - s : e] for e, s in zip(ends.tolist(), size.tolist(), strict=True)]
