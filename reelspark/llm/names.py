"""Variant spellings of names typed by people (problem 4).

Method: every spelling of a row (both name columns and the aliases, and the
reading of kana in Latin letters) is split into parts.  Pairs are verified by
Monge-Elkan similarity of the parts (typos, initials, shortened and reordered
parts, romanisation habits), the asked similarity depending on what else the
two rows share: works, voice actors, birth dates, weighted by rarity.
Unrelated holders of one name share none of it.  Links are clustered by star
clustering, so that a chain of links doesn't merge what no single row resembles.

As a link needs a shared work, voice actor or birth date, all pairs of rows are
compared within each of these, at every size; common items are cut into blocks,
and every pair of blocks is met.  Bands of q-grams can't choose the pairs:
verification accepts initials of Jaccard similarity near 0.1, where unrelated
names lie too.  An upper bound by length and letters, counted for all pairs of
two blocks at once on arrays, spares most pairs the edit distances and rejects
none that would be accepted.  Rows of one day and different years clash, so
these link by equal names only, which are looked up.  Support is the sum
over all shared items, common ones too; where it is weak, only nearly equal
names link.  Only an item that every row has says nothing.

Defined results: rows without any usable name link to nothing; null and blank
ids of the context are ignored; aliases that aren't a JSON list are read as
far as quoted strings or separators show; repeated rows of one id count once.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import clean_id
from ..session import Shelf

#: An item of more rows is paired in blocks of about so many.
LIMIT = 2000
#: The least similarity any support accepts, and the least that rows sharing nothing but day and month need.
LEAST, LEAST_DAY = 0.62, 0.8
#: Similarity asked where what two rows share is common to very many.
LEAST_WEAK = 0.95

# Forms of address and marks of age around names.
_TITLES = {"captain", "capt", "dr", "sgt", "sergeant", "prof", "professor", "mr", "mrs", "ms", "miss", "sir", "lady", "lord", "st", "san", "sensei", "kun", "sama", "senpai", "chan", "dono", "キャプテン", "博士", "教授", "先生"}
_HONORIFIC = re.compile(r"(さん|ちゃん|くん|君|様|さま|先生|せんせい|殿|博士|軍曹|隊長|教授|先輩|氏)$")
_BRACKETS = re.compile(r"[(（\[〔【〈《「『][^)）\]〕】〉》」』]*[)）\]〕】〉》」』]")
_SPLIT = re.compile(r"[\s・·•=＝,、./／\-‐‑–—_゠‧･]+")
_ESC = re.compile(r"\\u([0-9a-fA-F]{4})")
_QUOTED = re.compile(r"\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'")


def alias_list(text: str | None) -> list[str]:
    """The aliases of a field that should be a JSON list but may be in another notation."""
    if not text:
        return []
    t = _ESC.sub(lambda m: chr(int(m[1], 16)), text.strip())
    if t.lower() in ("", "null", "none", "[]", "{}", "nan"):
        return []
    found = [a or b for a, b in _QUOTED.findall(t)]
    return [x.strip() for x in (found or re.split(r"[;,、|/\n]", t.strip("[]{}"))) if x.strip()]


@lru_cache(maxsize=4096)
def _kana(c: str) -> str | None:
    """The Latin name Unicode gives a kana, lower case; small ones with a leading ``~``."""
    name = unicodedata.name(c, "")
    m = re.fullmatch(r"(?:HIRAGANA|KATAKANA) LETTER (SMALL )?([A-Z]{1,3})", name)
    return None if not m else ("~" if m[1] else "") + m[2].lower()


def kana_reading(text: str) -> str | None:
    """Latin reading of a text in kana alone (parts separated by blanks); null if other letters occur."""
    out: list[str] = []
    for c in text:
        k = _kana(c)
        if k is None:
            if c == "ー":
                continue
            if c == "っ" or c == "ッ":
                continue
            if c.isalpha():
                return None
            out.append(" ")
        elif k.startswith("~"):
            k = k[1:]
            if k == "tu":
                continue
            if out and out[-1].strip():
                out[-1] = out[-1][:-1] + k
            else:
                out.append(k)
        else:
            out.append(k)
    t = " ".join("".join(out).split())
    return t or None


# Spellings of the same sounds in the usual romanisations, applied in this order.
_SOUNDS = [
    ("tsu", "tu"), ("shi", "si"), ("chi", "ti"), ("sh", "sy"), ("ch", "ty"), ("ji", "zi"), ("j", "zy"), ("dj", "zy"), ("th", "s"), ("ph", "h"), ("qu", "ku"), ("q", "k"), ("x", "kusu"),
    ("ce", "se"), ("ci", "si"), ("cy", "si"), ("c", "k"), ("f", "h"), ("l", "r"), ("v", "b"), ("oh", "o"), ("ou", "o"), ("oo", "o"), ("uu", "u"), ("aa", "a"), ("ii", "i"), ("ee", "e"),
]


@lru_cache(maxsize=65536)
def _sound(part: str) -> str:
    for a, b in _SOUNDS:
        part = part.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", part)


def name_parts(text: str | None) -> tuple[str, ...]:
    """The parts of one spelling: compatibility form, lower case, without brackets, titles and marks."""
    if not text:
        return ()
    t = unicodedata.normalize("NFKC", text)
    t = _BRACKETS.sub(" ", t).lower()
    t = "".join(c for c in t if unicodedata.category(c) not in ("Cf", "Cc"))
    parts = [p for p in _SPLIT.split(t) if p]
    if len(parts) > 1:
        parts = [p for p in parts if p.strip("'\"") not in _TITLES] or parts
    if parts and not parts[-1].isascii():
        parts[-1] = _HONORIFIC.sub("", parts[-1]) or parts[-1]
    return tuple(p for p in ("".join(c for c in p if c.isalnum()) for p in parts) if p)


def _is_latin(parts: tuple[str, ...]) -> bool:
    return all(ord(c) < 0x250 for p in parts for c in p)


def _is_nickname(parts: tuple[str, ...]) -> bool:
    """One short part: many characters share such an alias, so it says nothing about identity."""
    return len(parts) == 1 and len(parts[0]) < (7 if _is_latin(parts) else 5)


def spellings(name_ja: str | None, name_en: str | None, aliases: str | None) -> list[tuple[str, ...]]:
    """All spellings of a row as parts; Latin ones in one romanisation and kana ones also by reading; names before aliases."""
    out: dict[tuple[str, ...], None] = {}
    for n, alias in [(name_ja, False), (name_en, False), *((a, True) for a in alias_list(aliases))]:
        parts = name_parts(n)
        if not parts or sum(map(len, parts)) < 3 or alias and _is_nickname(parts):
            continue
        if _is_latin(parts):
            parts = tuple(_sound(p) for p in parts)
        out.setdefault(parts)
        reading = None if _is_latin(parts) else kana_reading(" ".join(parts))
        if reading:
            out.setdefault(tuple(_sound(p) for p in reading.split()))
    return list(out)


def _edit(a: str, b: str) -> float:
    """1 - Damerau distance (neighbouring swaps count one) / longer length."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    # a column of the distances at a time, as bits that tell where they rise and fall (Hyyrö 2003, with swaps)
    full, top = (1 << n) - 1, 1 << n - 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    up, down, flat, before, edits = full, 0, 0, 0, n
    for c in b:
        here = where.get(c, 0)
        flat = ((here & up) + up ^ up | here | down | (~flat & here) << 1 & before) & full
        rise, fall = down | ~(flat | up) & full, flat & up
        edits += (rise & top > 0) - (fall & top > 0)
        rise = rise << 1 | 1
        up, down, before = (fall << 1 | ~(flat | rise)) & full, rise & flat, here
    return 1.0 - edits / max(n, m)


def _is_kana(part: str) -> bool:
    return all(_kana(c) or c == "ー" for c in part)


@lru_cache(maxsize=200_000)
def part_similarity(a: str, b: str) -> float:
    """Inner similarity: edits, or 0.9 for an initial and 0.85 for a shortened part."""
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    s = _edit(a, b)
    if _is_kana(a) != _is_kana(b) and not (a + b).isascii():
        return max(s, 0.45)  # a reading and its characters can't be compared
    if len(a) == 1 and b[0] == a:
        return max(s, 0.9 if a.isascii() else 0.7)
    if len(a) >= 2 and b.startswith(a):
        return max(s, 0.85)
    return s


def monge_elkan(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Mean over the parts of the best match on the other side, of both directions; or of the joined spellings, if higher."""
    one = sum(max(part_similarity(x, y) for y in b) for x in a) / len(a)
    two = sum(max(part_similarity(x, y) for x in a) for y in b) / len(b)
    best = (one + two) / 2
    if len(a) != len(b) or len(a) == 1:
        x, y = "".join(a), "".join(b)
        best = max(best, _edit(x, y), _edit("".join(reversed(a)), y))
    return best


def row_similarity(a: list[tuple[str, ...]], b: list[tuple[str, ...]]) -> float:
    """The best Monge-Elkan similarity of two spellings in the same kind of letters."""
    best = 0.0
    for x in a:
        for y in b:
            if _is_latin(x) == _is_latin(y):
                best = max(best, monge_elkan(x, y))
                if best == 1.0:
                    return best
    return best


def context(rows: DataFrame, cast: DataFrame) -> DataFrame:
    """(id, item, kind, w): works, voice actors and birth dates of a row; w is near 1 for rare items, near 0 for common ones."""
    links = cast.select(clean_id("character_id").alias("id"), clean_id("anime_id").alias("work"), clean_id("person_id").alias("voice")).filter(F.col("id").isNotNull())
    birth = F.regexp_extract("date_of_birth", r"(\d{1,2}-\d{1,2})$", 1)
    full = F.regexp_extract("date_of_birth", r"^(\d{4}-\d{1,2}-\d{1,2})$", 1)
    items = links.select("id", F.explode(F.array(F.struct(F.lit("work").alias("kind"), F.col("work").alias("item")), F.struct(F.lit("voice").alias("kind"), F.col("voice").alias("item")))).alias("i")).select("id", "i.kind", "i.item")
    dates = rows.select("id", F.explode(F.array(F.struct(F.lit("birth").alias("kind"), full.alias("item")), F.struct(F.lit("day").alias("kind"), F.when(F.col("date_of_birth").rlike(r"^(\d{4}|-)-\d{1,2}-\d{1,2}$"), birth).alias("item")))).alias("i")).select("id", "i.kind", "i.item")
    items = items.unionByName(dates).filter(F.coalesce(F.col("item"), F.lit("")) != "").distinct()
    known = items.join(rows.select("id"), "id", "left_semi")
    seen = known.groupBy("kind", "item").agg(F.count("*").alias("df"))
    n = F.lit(max(2, rows.count()))
    return known.join(seen, ["kind", "item"]).select("id", F.concat_ws(":", F.substring("kind", 1, 1), "item").alias("item"), "kind", (1 - F.log("df") / F.log(n)).alias("w")).filter(F.col("w") > 0)


def _spell_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [[" ".join(p) for p in spellings(*r)] for r in zip(b["name_ja"], b["name_en"], b["aliases"], strict=True)]
        yield pd.DataFrame({"id": b["id"], "forms": found})


@lru_cache(maxsize=65536)
def _letters(part: str) -> int:
    """The set of a part's characters as bits; several characters may share one."""
    m = 0
    for c in part:
        m |= 1 << ord(c) % 251
    return m


def _most(a: str, b: str) -> float:
    """Upper bound of ``part_similarity`` and ``_edit``: a character the other side lacks costs an edit."""
    x, y = _letters(a), _letters(b)
    edits = max((x & ~y).bit_count(), (y & ~x).bit_count(), abs(len(a) - len(b)))
    s = 1.0 - edits / max(len(a), len(b))
    if s < 0.9 and a[0] == b[0] and (a.startswith(b) or b.startswith(a)):
        return 0.9
    return s if s > 0.45 else 0.45


def _can_reach(a: tuple[str, ...], b: tuple[str, ...], least: float) -> bool:
    """False only if ``monge_elkan`` of these is below ``least``."""
    least -= 1e-9
    each = [[_most(x, y) for y in b] for x in a]
    if sum(map(max, each)) / len(a) + sum(map(max, zip(*each, strict=True))) / len(b) >= 2 * least:
        return True
    return (len(a) != len(b) or len(a) == 1) and _most("".join(a), "".join(b)) >= least


@lru_cache(maxsize=20_000)
def _split_forms(text: str) -> list[tuple[bool, tuple[str, ...]]]:
    parts = [tuple(f.split(" ")) for f in text.split("\n")]
    return [(_is_latin(p), p) for p in parts]


def similarity_from(a: str, b: str, least: float) -> float:
    """``row_similarity`` of two rows' spellings (one a line) if it is at least ``least``, else 0."""
    best = 0.0
    for latin_x, x in _split_forms(a):
        for latin_y, y in _split_forms(b):
            if latin_x == latin_y and _can_reach(x, y, max(best, least)):
                best = max(best, monge_elkan(x, y))
                if best == 1.0:
                    return best
    return best if best >= least else 0.0


#: Buckets of characters counted for the bound, pairs of spellings bounded at once, and pairs of rows from which arrays pay.
WIDTH, CELLS, FEW = 127, 1_000_000, 150


@lru_cache(maxsize=65536)
def _marks(text: str) -> tuple[int, ...]:
    """Buckets of a text's characters, a repeated one in a bucket of its own; several may share one."""
    seen: dict[str, int] = {}
    out = set()
    for c in text:
        out.add((ord(c) + 37 * seen.get(c, 0)) % WIDTH)
        seen[c] = seen.get(c, 0) + 1
    return tuple(out)


class _Texts:
    """Texts as arrays: buckets of their characters, numbers of these, lengths, and whether they are kana."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        marks = [_marks(x) for x in texts]
        self.size = np.array([len(m) for m in marks], dtype=np.float32)
        self.length = np.array([len(x) for x in texts], dtype=np.float32)
        self.bits = np.zeros((len(texts), WIDTH), dtype=np.float32)
        self.bits[np.repeat(np.arange(len(texts)), [len(m) for m in marks]), np.fromiter((i for m in marks for i in m), dtype=np.int64)] = 1.0

    def pick(self, at: np.ndarray) -> _Texts:
        out = object.__new__(_Texts)
        out.texts, out.size, out.length, out.bits = [], self.size[at], self.length[at], self.bits[at]
        return out

    def most(self, other: _Texts) -> np.ndarray:
        """Upper bounds of ``_edit``, all of these with all of the others: each character the other side lacks costs an edit."""
        s = self.bits @ other.bits.T
        s -= np.maximum(self.size[:, None], other.size)
        s /= np.maximum(self.length[:, None], other.length)
        s += 1.0
        return s

    def most_parts(self, other: _Texts, latin: bool) -> np.ndarray:
        """Upper bounds of ``part_similarity``; both sides are sorted and distinct."""
        s = self.most(other)
        if not latin:
            kana = [np.array([_is_kana(x) for x in side.texts]) for side in (self, other)]
            np.maximum(s, 0.45, out=s, where=kana[0][:, None] != kana[1])
        for rows, one, two in ((s, self.texts, other.texts), (s.T, other.texts, self.texts)):
            for i, x in enumerate(one):
                at, end = bisect_left(two, x), bisect_left(two, x + "\U0010ffff")
                if at < end:
                    rows[i, at:end] = np.maximum(rows[i, at:end], 0.85 if len(x) > 1 else 0.9)
        return s


class _Spelled:
    """The spellings of a block's rows in one kind of letters as arrays; ``row`` ascends."""

    def __init__(self, forms: list[str], latin: bool) -> None:
        got = [(i, p) for i, f in enumerate(forms) for kind, p in _split_forms(f) if kind == latin]
        self.row = np.array([i for i, _ in got], dtype=np.int64)
        self.spell = [p for _, p in got]
        self.n = np.array([len(p) for p in self.spell], dtype=np.int64)
        self.latin = latin

    def cut(self, first: int, last: int | None = None) -> _Spelled:
        """The spellings from one place to another."""
        out = object.__new__(_Spelled)
        out.row, out.spell, out.n, out.latin = self.row[first:last], self.spell[first:last], self.n[first:last], self.latin
        return out

    def read(self) -> _Spelled:
        parts = sorted({x for p in self.spell for x in p})
        at = {x: i for i, x in enumerate(parts)}
        self.parts, self.joined = _Texts(parts), _Texts(["".join(p) for p in self.spell])
        # per place of a part: the spellings that have it, and which part it is
        self.places = [(np.flatnonzero(self.n > k), np.array([at[p[k]] for p in self.spell if len(p) > k], dtype=np.int64)) for k in range(max(self.n))]
        return self


def _best(s: np.ndarray, side: _Spelled) -> np.ndarray:
    """The rows of ``s`` (one a part) maximised over the parts of each spelling."""
    out = s[side.places[0][1]]
    for have, part in side.places[1:]:
        out[have] = np.maximum(out[have], s[part])
    return out


def _mean(s: np.ndarray, side: _Spelled) -> np.ndarray:
    """The rows of ``s`` (one a part) averaged over the parts of each spelling."""
    out = s[side.places[0][1]]
    for have, part in side.places[1:]:
        out[have] += s[part]
    out /= side.n[:, None]
    return out


def _near_spellings(x: _Spelled, y: _Spelled, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``x`` and ``y`` of all spellings whose ``monge_elkan`` may reach ``least``."""
    s = x.parts.most_parts(y.parts, x.latin)
    bound = _mean(np.ascontiguousarray(_best(np.ascontiguousarray(s.T), y).T), x)
    bound += _mean(np.ascontiguousarray(_best(s, x).T), y).T
    near = bound >= 2 * least - 1e-3
    for n in np.unique(x.n):
        rows, cols = np.flatnonzero(x.n == n), np.flatnonzero((y.n != n) | (n == 1))
        if len(cols):
            near[np.ix_(rows, cols)] |= x.joined.pick(rows).most(y.joined.pick(cols)) >= least - 1e-3
    return np.nonzero(near)


def _alike(xs: list[tuple], ys: list[tuple] | None, least: float) -> Iterator[tuple[str, str, float]]:
    """(a, b, sim), a < b, of all rows (id, spellings, ...) of two lists, or of one, with ``row_similarity`` of at least ``least``."""
    if len(xs) * len(xs if ys is None else ys) <= FEW:
        for x, y in combinations(xs, 2) if ys is None else product(xs, ys):
            (a, fa, *_), (b, fb, *_) = (x, y) if x[0] < y[0] else (y, x)
            s = similarity_from(fa, fb, least)
            if s > 0:
                yield a, b, s
        return
    best: dict[tuple[str, str], float] = {}
    for latin in (True, False):
        left = _Spelled([x[1] for x in xs], latin)
        right = left if ys is None else _Spelled([y[1] for y in ys], latin)
        if not left.spell or not right.spell:
            continue
        other = xs if ys is None else ys
        step = max(1, CELLS // len(right.spell))
        whole = None if ys is None else right.read()
        for at in range(0, len(left.spell), step):
            one = left.cut(at, at + step).read()
            two = whole or right.cut(at).read()  # within one list a spelling meets the later ones
            for i, j in zip(*(v.tolist() for v in _near_spellings(one, two, least)), strict=True):
                x, y = xs[one.row[i]], other[two.row[j]]
                if ys is None and one.row[i] >= two.row[j] or x[0] == y[0]:
                    continue
                s = monge_elkan(one.spell[i], two.spell[j]) if x[0] < y[0] else monge_elkan(two.spell[j], one.spell[i])
                if s >= least:
                    pair = (x[0], y[0]) if x[0] < y[0] else (y[0], x[0])
                    if s > best.get(pair, 0.0):
                        best[pair] = s
    for (a, b), s in best.items():
        yield a, b, s


def _same_names(xs: list[tuple], ys: list[tuple] | None) -> Iterator[tuple[str, str, float]]:
    """(a, b, 1.0), a < b, of all rows (id, spellings, ...) of two lists, or of one, with ``row_similarity`` of 1."""

    def keys(forms: str) -> set[str]:
        spell = [p for _, p in _split_forms(forms)]
        return {" ".join(sorted(set(p))) for p in spell} | {"".join(p) for p in spell} | {"".join(reversed(p)) for p in spell}

    by: dict[str, list[int]] = {}
    for j, y in enumerate(xs if ys is None else ys):
        for k in keys(y[1]):
            by.setdefault(k, []).append(j)
    for i, x in enumerate(xs):
        for j in {j for k in keys(x[1]) for j in by.get(k, ()) if ys is not None or j > i}:
            y = xs[j] if ys is None else ys[j]
            (a, fa, *_), (b, fb, *_) = (x, y) if x[0] < y[0] else (y, x)
            if a != b and similarity_from(fa, fb, 1.0) == 1.0:
                yield a, b, 1.0


def _same_day(xs: list[tuple], ys: list[tuple] | None) -> Iterator[tuple[str, str, float]]:
    """Pairs of one day and month: with a year on both sides the dates clash (or the birth date is shared, another item), so only equal names link."""
    split = lambda rows: ([r for r in rows if r[2] is None], [r for r in rows if r[2] is not None])
    (x0, x1), (y0, y1) = split(xs), (None, None) if ys is None else split(ys)
    if ys is None:
        yield from _alike(x0, None, LEAST_DAY)
        yield from _alike(x0, x1, LEAST_DAY)
    else:
        yield from _alike(x0, ys, LEAST_DAY)
        yield from _alike(x1, y0, LEAST_DAY)
    yield from _same_names(x1, y1)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got: list[tuple[str, str, float]] = []
        sides = []
        for name in ("xs", "ys"):
            col = b.column(name)
            rows = list(zip(*(col.values.field(f).to_pylist() for f in ("id", "forms", "born")), strict=True))
            ends = col.offsets.to_pylist()
            sides.append([rows[i:j] for i, j in zip(ends, ends[1:], strict=False)])
        for kind, within, xs, ys in zip(b.column("kind").to_pylist(), b.column("within").to_pylist(), *sides, strict=True):
            got += _same_day(xs, None if within else ys) if kind == "day" else _alike(xs, None if within else ys, LEAST)
            if len(got) >= 20_000:
                yield pa.RecordBatch.from_pylist([dict(zip(("a", "b", "sim"), r, strict=True)) for r in got], _PAIR)
                got = []
        yield pa.RecordBatch.from_pylist([dict(zip(("a", "b", "sim"), r, strict=True)) for r in got], _PAIR)


_PAIR = pa.schema([("a", pa.string()), ("b", pa.string()), ("sim", pa.float64())])


def candidates(forms: DataFrame, ctx: DataFrame, shelf: Shelf) -> DataFrame:
    """(a, b, sim), a < b: all pairs of rows that share an item of their context and are similar enough for some support."""
    shared = ctx.groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    spelled = forms.filter(F.size("forms") > 0).select("id", F.concat_ws("\n", "forms").alias("forms"))
    born = ctx.filter(F.col("kind") == "birth").groupBy("id").agg(F.min("item").alias("born"))
    # blocks of a common item: a row of block p meets the blocks p and above as first, p and below as second
    k = F.ceil(F.col("n") / LIMIT).cast("int")
    p = F.pmod(F.xxhash64("id"), k).cast("int")
    rows = ctx.join(shared, "item").join(spelled, "id").join(born, "id", "left").select("item", "kind", k.alias("k"), p.alias("p"), F.struct("id", "forms", "born").alias("r"))
    rows = shelf.put(rows, "items")
    met = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda q: F.struct(F.least(q, "p").alias("i"), F.greatest(q, "p").alias("j")))
    blocks = rows.select("item", "kind", "p", "r", F.explode(met).alias("m")).select("item", "kind", "m.i", "m.j", (F.col("p") == F.col("m.i")).alias("first"), "r")
    side = lambda first: F.collect_list(F.when(F.col("first") == first, F.col("r")))
    blocks = blocks.groupBy("item", "kind", "i", "j").agg(side(True).alias("xs"), side(False).alias("ys")).select("kind", (F.col("i") == F.col("j")).alias("within"), "xs", "ys")
    blocks = blocks.filter(F.when(F.col("within"), F.size("xs") > 1).otherwise((F.size("xs") > 0) & (F.size("ys") > 0)))
    return blocks.mapInArrow(_compare, "a string, b string, sim double").groupBy("a", "b").agg(F.max("sim").alias("sim"))


def links(rows: DataFrame, cast: DataFrame, shelf: Shelf) -> DataFrame:
    """(a, b, sim, support) of verified pairs."""
    rows = rows.select(clean_id("id").alias("id"), "name_ja", "name_en", "aliases", "date_of_birth").filter(F.col("id").isNotNull()).dropDuplicates(["id"])
    ctx = shelf.put(context(rows, cast), "ctx")
    forms = shelf.put(rows.select("id", "name_ja", "name_en", "aliases").mapInPandas(_spell_rows, "id string, forms array<string>"), "forms")
    pairs = shelf.put(candidates(forms, ctx, shelf), "pairs")
    one = ctx.select(F.col("id").alias("a"), "item", "kind", "w")
    two = ctx.select(F.col("id").alias("b"), "item")
    shared = pairs.join(one, "a").join(two, ["b", "item"]).groupBy("a", "b", "sim").agg(*[F.sum(F.when(F.col("kind") == k, F.col("w")).otherwise(0.0)).alias(k) for k in ("work", "voice", "birth", "day")])
    birth = rows.select("id", F.col("date_of_birth").alias("dob"))
    got = shared.join(birth.withColumnsRenamed({"id": "a", "dob": "dob_a"}), "a").join(birth.withColumnsRenamed({"id": "b", "dob": "dob_b"}), "b")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            clash = [dates_clash(x, y) for x, y in zip(b["dob_a"], b["dob_b"], strict=True)]
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "sim": b["sim"], "clash": clash, **{k: b[k] for k in ("work", "voice", "birth", "day")}})

    judged = got.mapInPandas(judge, "a string, b string, sim double, clash boolean, work double, voice double, birth double, day double")
    support = F.least(F.col("work"), F.lit(1.5)) + F.least(F.col("voice"), F.lit(1.5)) + F.when(F.col("birth") > 0, 1.0).when(F.col("day") > 0, 0.8).otherwise(0.0)
    judged = shelf.put(judged.withColumn("support", support), "judged")
    asked = F.when(F.col("support") >= 1.5, LEAST).when(F.col("support") >= 0.9, 0.7).when(F.col("support") >= 0.5, LEAST_DAY).when(F.col("support") >= 0.25, 0.9).otherwise(LEAST_WEAK)
    asked = asked + F.when(F.col("clash"), 0.2).otherwise(0.0)
    return judged.filter(F.col("sim") >= asked).select("a", "b", "sim", "support")


_DATE = re.compile(r"^(\d{4}|-)?(?:-(\d{1,2}))?(?:-(\d{1,2}))?$")


def dates_clash(a: str | None, b: str | None) -> bool:
    """Two partial dates (``YYYY``, ``YYYY-MM``, ``--MM-DD``, ...) that differ in a part both have."""
    if not a or not b:
        return False
    x, y = _DATE.match(a.strip()), _DATE.match(b.strip())
    if not x or not y:
        return False
    return any(p and q and p != "-" and q != "-" and int(p) != int(q) for p, q in zip(x.groups(), y.groups(), strict=True))


def star_clusters(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """(id, center) of star clusters of ``edges`` (a, b, sim).

    A row becomes a centre if no neighbour without cluster has more neighbours
    (ties: higher total similarity, then smaller id); its neighbours join the
    most similar centre next to them.  Repeated on what is left.
    """
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v"), "sim"), F.struct(F.col("b").alias("u"), F.col("a").alias("v"), "sim"))).alias("e")).select("e.*")
    graph = shelf.put(both, "star0")
    out: DataFrame | None = None
    k = 0
    while not graph.isEmpty():
        rank = F.struct(F.count("*").alias("n"), F.round(F.sum("sim"), 6).alias("s"))
        deg = shelf.put(graph.groupBy("u").agg(rank.alias("r")), f"deg{k}")
        v = deg.select(F.col("u").alias("v"), F.col("r").alias("rv"))
        over = graph.join(deg, "u").join(v, "v").filter((F.col("rv") > F.col("r")) | ((F.col("rv") == F.col("r")) & (F.col("v") < F.col("u")))).select("u").distinct()
        centers = shelf.put(deg.select("u").join(over, "u", "left_anti"), f"centers{k}")
        near = graph.join(centers.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.max(F.struct("sim", "v")).alias("m")).select(F.col("u").alias("id"), F.col("m.v").alias("center"))
        done = shelf.put(near.join(centers.select(F.col("u").alias("id")), "id", "left_anti").unionByName(centers.select(F.col("u").alias("id"), F.col("u").alias("center"))), f"done{k}")
        out = done if out is None else out.unionByName(done)
        left = graph.join(done.select(F.col("id").alias("u")), "u", "left_anti").join(done.select(F.col("id").alias("v")), "v", "left_anti")
        graph = shelf.put(left.select("u", "v", "sim"), f"star{k + 1}")
        shelf.drop(f"star{k}")
        k += 1
    return out if out is not None else graph.select(F.col("u").alias("id"), F.col("v").alias("center"))


def name_clusters(rows: DataFrame, cast: DataFrame) -> DataFrame:
    """(id, center): every row that is linked to another, with its cluster's centre."""
    shelf = Shelf(rows.sparkSession, "names")
    return star_clusters(shelf.put(links(rows, cast, shelf), "links"), shelf)


def cluster_pairs(clusters: DataFrame) -> DataFrame:
    """All pairs (id_a < id_b) of each cluster."""
    a, b = (clusters.select("center", F.col("id").alias(f"id_{x}")) for x in "ab")
    return a.join(b, "center").filter(F.col("id_a") < F.col("id_b")).select("id_a", "id_b")
