"""Long exact spans shared between records (problem 10).

A character is shared if it lies in a stretch of at least ``min_len``
characters that occurs verbatim in the text of another document.

Method: level-wise doubling.  Windows of a short length that occur in two
different texts are the candidates; only what surrounds them is looked at with
windows of twice that length, and so on, until no candidates survive or
``min_len`` is reached.  At the levels below ``min_len`` not all windows are
needed: the content picks them by winnowing (a window is picked if its hash is
the smallest among neighbouring ones), which guarantees that every stretch of
``min_len`` characters holds a picked window of that level and that equal
stretches pick equal windows.  At the last level every start is a window.

Only hashes, positions and, after the first level, the short surroundings of
surviving windows are shuffled; the corpus text is shuffled at most once, for
documents with survivors.  Repeats are found by an aggregation on the window's
hash (least and greatest text), never by listing a hash's documents, so a
passage may occur in a third of all documents.  Exact copies of a text count
as one text; that a text has a copy makes it shared as a whole.

Windows are compared by a 64-bit hash at the lower levels and by two
independent 64-bit hashes at the last one.

Defined results: positions are 0-based code points, the end exclusive; a null,
empty or short text has no span; repeats within one document don't count; the
same text under two ids counts as two documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup_join
from ..session import Shelf

MIN_LEN = 200
#: Windows of the first level are at least this long.
FIRST = 50

_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_U = np.uint64


def levels(min_len: int, first: int = FIRST) -> list[int]:
    """Window lengths, doubling up to ``min_len``: e.g. [50, 100, 200]."""
    out = [min_len]
    while out[0] // 2 >= first:
        out.insert(0, out[0] // 2)
    return out


class _Powers:
    """Powers of a base modulo 2^64 and of its inverse, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inv, self.n = base, pow(base, -1, 2**64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            one = np.ones(1, _U)
            self.up = np.concatenate([one, np.cumprod(np.full(self.n - 1, self.base, _U), dtype=_U)])
            self.down = np.concatenate([one, np.cumprod(np.full(self.n - 1, self.inv, _U), dtype=_U)])
        return self.up[:n], self.down[:n]


_POWERS = [_Powers(b) for b in _BASE]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mixed code points of all texts in a row, and each text's start (and the end)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    return _mix(raw + _U(0x9E3779B97F4A7C15)), starts


def _hashes(codes: np.ndarray, length: int, which: int) -> np.ndarray:
    """Hash of the window at every start; windows that cross two texts must be masked by the caller."""
    n = len(codes)
    if n < length:
        return np.empty(0, _U)
    up, down = _POWERS[which].upto(n)
    sums = np.zeros(n + 1, _U)
    np.cumsum(codes * up, out=sums[1:], dtype=_U)
    return _mix((sums[length:] - sums[:-length]) * down[: n - length + 1])


def _inside(starts: np.ndarray, length: int) -> np.ndarray:
    """True for every start whose window of ``length`` stays within its text."""
    n = int(starts[-1])
    ok = np.ones(max(0, n - length + 1), bool)
    for e in starts[1:-1]:
        ok[max(0, e - length + 1) : e] = False
    return ok


def _picked(codes: np.ndarray, starts: np.ndarray, length: int, min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the picked windows: every stretch of ``min_len`` within a text holds one."""
    h = _hashes(codes, length, 0)
    if not len(h):
        return np.empty(0, np.int64), h
    top = _U(0xFFFFFFFFFFFFFFFF)
    h = np.where(_inside(starts, length), h, top)
    w = min_len - length + 1  # windows of this length in a stretch of min_len
    if len(h) < w:
        return np.empty(0, np.int64), h[:0]
    low, width = h, 1  # low[i] = least of h[i : i + width]
    while width * 2 <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < w:
        low = np.minimum(low[: len(low) - (w - width)], low[w - width :])
    # a window is picked if it is the least of some stretch within one text; ties are all picked
    whole = _inside(starts, min_len)
    low = np.where(whole, low, _U(0))
    high, width = np.concatenate([np.zeros(w - 1, _U), low, np.zeros(w - 1, _U)]), 1
    while width * 2 <= w:
        high = np.maximum(high[:-width], high[width:])
        width *= 2
    if width < w:
        high = np.maximum(high[: len(high) - (w - width)], high[w - width :])
    at = np.flatnonzero((h == high[: len(h)]) & (h != top))
    return at, h[at]


def _runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of [lo, hi) intervals given in order of lo; touching ones are joined."""
    end = np.maximum.accumulate(hi)
    new = np.concatenate([[True], lo[1:] > end[:-1]])
    at = np.flatnonzero(new)
    return lo[at], end[np.append(at[1:], len(lo)) - 1]


#: Characters hashed at once; a longer text is still hashed as a whole.
CHUNK = 1 << 20


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches in pieces of about ``CHUNK`` characters."""
    for b in batches:
        if len(b):
            at = b["text"].str.len().cumsum().to_numpy() // CHUNK
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(b)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                yield b.iloc[i:j]


def _picks(length: int, min_len: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _chunks(batches):
            codes, starts = _codes(b["text"].tolist())
            at, h = _picked(codes, starts, length, min_len)
            i = np.searchsorted(starts, at, "right") - 1
            yield pd.DataFrame({"h": h.view(np.int64), "part": b["part"].to_numpy()[i], "pos": (at - starts[i] + b["off"].to_numpy()[i]).astype(np.int32)})

    return run


def _windows(length: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _chunks(batches):
            codes, starts = _codes(b["text"].tolist())
            at = np.flatnonzero(_inside(starts, length))
            if not len(at):
                continue
            h, g = (_hashes(codes, length, k)[at] for k in (0, 1))
            i = np.searchsorted(starts, at, "right") - 1
            yield pd.DataFrame({"h": h.view(np.int64), "g": g.view(np.int64), "part": b["part"].to_numpy()[i], "pos": (at - starts[i] + b["off"].to_numpy()[i]).astype(np.int32)})

    return run


def _surroundings(length: int, min_len: int):  # noqa: ANN202
    """Pieces of a text within which a stretch of ``min_len`` can hold a surviving window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for part, off, text, at in zip(b["part"], b["off"], b["text"], b["at"], strict=True):
                p = np.sort(np.asarray(at, np.int64))
                lo, hi = np.maximum(p + length - min_len, off), np.minimum(p + min_len, off + len(text))
                for s, e in zip(*_runs(lo, hi), strict=True):
                    if e - s >= min_len:
                        rows.append((part, int(s), text[s - off : e - off]))
            yield pd.DataFrame(rows, columns=["part", "off", "text"])

    return run


_PICK = "h long, part long, pos int"
_TEXT = "part long, off int, text string"


def _repeated(rows: DataFrame, key: list[str], shelf: Shelf, name: str) -> DataFrame:
    """The stored rows whose ``key`` occurs in two different texts; the rows of a common key stay where they are."""
    one = F.col(key[0]) if len(key) == 1 else F.struct(*key)
    rows = rows.withColumn("window", one)
    twice = rows.groupBy("window").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.count("*").alias("n")).filter(F.col("a") != F.col("b")).select("window", "n")
    return lookup_join(rows, rows.count(), shelf.put(twice, name), "window", "n").drop("window")


def shared_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_len: int = MIN_LEN, first: int = FIRST) -> DataFrame:
    """(doc_id, n_chars, spans array<struct<start,end>>, shared_chars) of every document with a shared span."""
    shelf = Shelf(docs.sparkSession, "spans")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.length("text") >= min_len)
    # a text's class is the least id of its copies; the 128-bit digest stands for the text
    classes = docs.select("doc_id", F.unhex(F.md5("text")).alias("digest"), F.length("text").alias("n_chars"))
    classes = shelf.put(classes.select("doc_id", "n_chars", F.struct("digest", "n_chars").alias("same")), "classes")
    kept = classes.groupBy("same").agg(F.min("doc_id").alias("part"), F.count("*").alias("copies")).withColumn("n", F.col("copies"))
    kept = shelf.put(kept, "kept")
    members = shelf.put(lookup_join(classes, classes.count(), kept, "same", "n").select("doc_id", "part", "copies", "n_chars"), "members")
    copied = members.filter(F.col("copies") > 1)
    extra = copied.filter(F.col("doc_id") != F.col("part")).select("doc_id", "part")

    parts = docs.select(F.col("doc_id").alias("part"), F.lit(0).alias("off"), "text")
    steps = levels(min_len, first)
    for k, length in enumerate(steps[:-1]):
        picks = shelf.put(parts.mapInPandas(_picks(length, min_len), _PICK), f"picks{k}")
        # copies pick the same windows: they count as the class's representative
        picks = picks.join(extra.select(F.col("doc_id").alias("part")), "part", "left_anti") if k == 0 else picks
        at = _repeated(picks, ["h"], shelf, f"twice{k}").groupBy("part").agg(F.collect_set("pos").alias("at"))
        if k == 0:
            held = parts.join(at, "part")
        else:
            # positions belong to the piece that holds them; a text's pieces don't overlap
            held = parts.join(at, "part").withColumn("at", F.filter("at", lambda p: (p >= F.col("off")) & (p + length <= F.col("off") + F.length("text")))).filter(F.size("at") > 0)
        parts = shelf.put(held.mapInPandas(_surroundings(length, min_len), _TEXT), f"parts{k + 1}")
        shelf.drop(f"picks{k}")
    if len(steps) == 1:
        parts = parts.join(extra.select(F.col("doc_id").alias("part")), "part", "left_anti")
    windows = shelf.put(parts.mapInPandas(_windows(min_len), "h long, g long, part long, pos int"), "windows")
    at = _repeated(windows, ["h", "g"], shelf, "twice").groupBy("part").agg(F.sort_array(F.collect_set("pos")).alias("at"))

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b["at"]:
                lo = np.asarray(p, np.int64)
                out.append([{"start": int(s), "end": int(e)} for s, e in zip(*_runs(lo, lo + min_len), strict=True)])
            yield pd.DataFrame({"part": b["part"], "spans": out})

    found = at.mapInPandas(spans, "part long, spans array<struct<start:int,end:int>>")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_chars").alias("end")))
    out = members.join(found, "part", "left").withColumn("spans", F.when(F.col("copies") > 1, whole).otherwise(F.col("spans"))).filter(F.col("spans").isNotNull())
    total = F.aggregate("spans", F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    return out.select("doc_id", "n_chars", "spans", total.alias("shared_chars"))
