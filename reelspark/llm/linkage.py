"""Matching entities across sources without keys (problem 3).

Method: collective graph linkage.

1. Nodes.  Each row of either table becomes a profile: both titles in one
   visual form without decoration, the season number and the film mark read
   from them, year, date and episode count where they are possible values.
   Rows with equal profiles are one node, so copies cost nothing.
2. Candidate graph.  An accepted pair has one title of score ``TITLE`` or more.
   All pairs of titles within the edits that score allows are found by Pass-Join:
   the longer title is cut into one part more than edits, one of which must stand
   in the shorter.  Titles shortened by one gap keep half of the shorter one at
   the start or the end of the longer.  Titles shortened by several gaps are met
   by their rarest q-grams, up to ``OVERLAP`` of a title's weight.
   Season, kind and year (or the full date) are part of each key, so titles of
   other years never meet, and no key is a date alone.
3. Keys are formed and met on arrays, in tasks that hold the titles of some
   seasons, kinds and years (``titles.py``): a title is shuffled a few times a
   channel, its keys never are.
4. Similarity.  Edits of the titles, agreement of year, date and episodes.
5. Propagation.  Nodes of one table that carry the same title and season are
   neighbours.  A pair's similarity moves towards the mean similarity of its
   neighbours' pairs with the same counterpart, until nothing changes by more
   than ``STABLE``; a node that lacks a year or a title is so carried by its
   neighbours, and one that only looks alike is not.
6. A counterpart keeps the nodes within ``NEAR`` of its best one.

Defined results: rows without any title are matched by nothing; null or
impossible years and counts are unknown; several rows of one raw id match if
any of them does; titles of any length are used whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import clean_id
from ..operators.blocks import read_table
from ..session import Shelf
from .survivor import FILLERS, usable_text
from .titles import LETTERS, Q_EN, Q_JA, TITLE, Texts, most_edits, pairs, rare_bits  # noqa: F401
from .visual import _EXTRA, lookalikes, visual_form

#: Titles of a token that a task holds of one side, titles of a task, about; titles shuffled and letters of which grams are counted at once.
SLICE, HELD, MOVED, GRAMS = 60_000, 120_000, 8_000_000, 40_000_000
ACCEPT = 0.77
NEAR = 0.12
PULL = 0.3
STABLE = 0.005

_DECOR = re.compile(r"[\[(（【〔〖［][^\])）】〕〗］]{0,8}[\])）】〕〗］]\s*$|[『』「」]")
# Ways to write the number of a season, on the text in lower case after compatibility normalisation.
_SEASON = re.compile(
    r"(?:^|[\s・:：~\-]*)(?:第\s*(\d+)\s*(?:期|シリーズ|シーズン)|(\d+)\s*(?:期|シリーズ|シーズン)|(?:season|part|series|シーズン|パート|その|s)\s*(\d+)|(\d+)(?:st|nd|rd|th)\s+season|(?<![a-z])(i{2,3}|iv|vi{0,3})(?![a-z])|(?<![\d])(\d))\s*$"
)
#: Last letters of these, other than digits.
_SEASON_ENDS = frozenset("期ズンniv")
_SIGNS = re.compile(r"[\W_]+")
_ROMAN = {"ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8}
_ARTICLE = re.compile(r"^(?:the|a|an)\s+")
_FILM = re.compile(r"^\s*劇\s?場版|^\s*映\s?画\s|^movie\s*:|\bthe movie\s*$|\bmovie\s*$")


def title_core(text: str | None, table: dict[int, str]) -> tuple[str, int, bool]:
    """(core, season, film) of a title: the core has letters and digits only."""
    if not text:
        return "", 0, False
    t = unicodedata.normalize("NFKC", text).lower()
    if not t.isprintable():
        t = "".join(c for c in t if unicodedata.category(c) not in ("Cf", "Cc"))
    t = t.strip()
    for _ in range(2):
        t = _DECOR.sub("", t).strip()
    film = bool(_FILM.search(t))
    t = _FILM.sub("", t).strip()
    season = 0
    m = _SEASON.search(t) if t and (t[-1] in _SEASON_ENDS or t[-1].isdecimal()) else None
    if m and m.start() > 0:
        g = next(x for x in m.groups() if x)
        season = _ROMAN.get(g) or int(g)
        t = t[: m.start()]
    plain = t.isascii() and t.isprintable()  # nothing to compose, ignore or take as a blank
    form = t.strip(" ").translate(table) if plain else visual_form(t, table)
    form = _ARTICLE.sub("", form.lower())
    return _SIGNS.sub("", form), season, film


def read_date(c: Column) -> Column:
    """``YYYY[-MM[-DD]]`` of the date notations in use; null if there is no possible year."""
    y = F.regexp_extract(c, r"((?:19|20)\d\d)", 1)
    m = F.regexp_extract(c, r"(?:19|20)\d\d(?:[-/.年]\s*|\D+month\D+)(\d{1,2})", 1)
    d = F.regexp_extract(c, r"(?:19|20)\d\d(?:[-/.年]\s*\d{1,2}[-/.月]\s*|\D+month\D+\d{1,2}\D+day\D+)(\d{1,2})", 1)
    md = F.when(m != "", F.concat(F.lit("-"), F.lpad(m, 2, "0"), F.when(d != "", F.concat(F.lit("-"), F.lpad(d, 2, "0"))).otherwise("")))
    return F.when(y != "", F.concat(y, F.coalesce(md, F.lit(""))))


def profiles(rows: DataFrame, key: Column, side: str) -> DataFrame:
    """(key, side, ja, en, season, film, year, date, episodes) of the rows of one table."""
    spark = rows.sparkSession
    table = {ord(k): v for k, v in lookalikes(spark).items() if len(unicodedata.normalize("NFD", k)) == 1} | {ord(k): v for k, v in _EXTRA.items()}
    shared = spark.sparkContext.broadcast(table)
    year = F.when(F.col("year").between(1900, 2100), F.col("year"))
    date = read_date(F.col("start_date"))
    eps = F.when((F.col("episodes") >= 1) & ~F.col("episodes").isin(*FILLERS), F.col("episodes"))
    text = lambda c: F.when(usable_text(F.col(c)), F.col(c))
    src = rows.select(key.alias("key"), text("title_ja").alias("title_ja"), text("title_en").alias("title_en"), F.coalesce(year, F.substring(date, 1, 4).cast("int")).alias("year"), date.alias("date"), eps.alias("episodes"))
    src = src.filter(F.col("key").isNotNull() & (F.col("title_ja").isNotNull() | F.col("title_en").isNotNull()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = shared.value
        for b in batches:
            ja = [title_core(x if isinstance(x, str) else None, t) for x in b["title_ja"]]
            en = [title_core(x if isinstance(x, str) else None, t) for x in b["title_en"]]
            out = b[["key", "year", "date", "episodes"]].copy()
            out["ja"], out["en"] = [x[0] for x in ja], [x[0] for x in en]
            out["season"] = [max(x[1], y[1], 1) for x, y in zip(ja, en, strict=True)]
            out["film"] = [x[2] or y[2] for x, y in zip(ja, en, strict=True)]
            yield out[["key", "ja", "en", "season", "film", "year", "date", "episodes"]]

    got = src.mapInPandas(run, "key string, ja string, en string, season int, film boolean, year int, date string, episodes int")
    return got.withColumn("side", F.lit(side))


_PROFILE = ["side", "ja", "en", "season", "film", "year", "date", "episodes"]


def contexts(wide: bool) -> Column:
    """What a pair must agree in, as tokens: season, kind and year (one apart at most, or unknown), or the full date.

    One side of a join takes the wide tokens, the other the narrow ones; a pair shares exactly one
    token of years if it agrees, and one of dates if both start on the same day.
    """
    token = lambda *c: F.xxhash64("season", "film", *c)
    around = [token(F.col("year") + i) for i in (-1, 0, 1)]
    if wide:
        years = F.when(F.col("year").isNull(), F.array(token(F.lit("of none")), token(F.lit("any")))).otherwise(F.array(*around, token(F.lit("any"))))
    else:
        years = F.when(F.col("year").isNull(), F.array(token(F.lit("any")))).otherwise(F.array(around[1], token(F.lit("of none"))))
    return years


def _day() -> Column:
    return F.when(F.length("date") == 10, F.xxhash64(F.lit("day"), "date"))


def rare_grams(named: DataFrame, c: str, q: int, n: int, shelf: Shelf) -> DataFrame:
    """``named`` with ``rare``, the places of the rarest grams of each ``text`` (see ``titles.rare_bits``) among ``n`` nodes."""
    passes = max(1, -(-(named.agg(F.sum(F.length("text"))).first()[0] or 0) // GRAMS))

    def count(k: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[np.ndarray] = []
            for x in batches:
                t = Texts(x["text"].tolist())
                h = t.grams(q, np.arange(len(t.n)))[2]
                held.append(h[h % np.uint64(passes) == k])
                if sum(map(len, held)) > 2_000_000:
                    yield seen(held)
                    held = []
            if held:
                yield seen(held)

        def seen(held: list[np.ndarray]) -> pd.DataFrame:
            gram, times = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"gram": gram.view(np.int64), "n": times})

        return named.select("text").mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1")

    paths = []
    for k in range(passes):
        shelf.put(count(k), f"common_{c}{k}")
        shelf.free()
        paths.append(f"{shelf.root}/common_{c}{k}")

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = times = None
        for x in batches:
            if common is None:
                tables = [read_table(p, ["gram", "n"]) for p in paths]
                common = np.concatenate([t.column("gram").to_numpy() for t in tables]).view(np.uint64)
                order = np.argsort(common)
                common, times = common[order], np.concatenate([t.column("n").to_numpy() for t in tables])[order]
            yield x.assign(rare=rare_bits(Texts(x["text"].tolist()), q, common, times, n))

    out = shelf.put(named.mapInPandas(mark, f"{', '.join(f'{k} {t}' for k, t in named.dtypes)}, rare binary"), f"named_{c}")
    for k in range(passes):
        shelf.drop(f"common_{c}{k}")
    shelf.free()
    return out


def title_mark(c: str) -> Column:
    """A text's letters, each with its how-manieth it is, as ``LETTERS`` bits (several may share one) below its length, 255 at most."""
    seen = f"length(replace(substring({c}, 1, i), substring({c}, i, 1), ''))"
    letters = F.expr(f"aggregate(sequence(1, length({c})), 0L, (m, i) -> m | shiftleft(1L, CAST(pmod(xxhash64(substring({c}, i, 1), i - {seen}), {LETTERS}) AS INT)))")
    return letters.bitwiseOR(F.shiftleft(F.least(F.length(c), F.lit(255)).cast("long"), LETTERS))


def may_agree(x: str, y: str) -> Column:
    """False only if ``_title_score`` of texts with these marks is below ``TITLE``: an edit takes away one letter of each at most."""
    letters = lambda a, b: F.expr(f"bit_count({a} & ~{b} & {2**LETTERS - 1}L)")
    lx, ly = (F.shiftrightunsigned(F.col(m), LETTERS) for m in (x, y))
    longest = F.greatest(lx, ly)
    edits = F.greatest(letters(x, y), letters(y, x), F.abs(lx - ly))
    gap = ((lx <= ly) & (letters(x, y) == 0)) | ((ly <= lx) & (letters(y, x) == 0))
    return (longest == 255) | (edits <= F.greatest(F.floor(longest * (1 - TITLE / 0.85) + 1e-9), F.lit(2))) | gap


def similar_titles(nodes: DataFrame, c: str, shelf: Shelf) -> DataFrame:
    """(a, r): all pairs of nodes of the two sides that agree in season, kind and year (or start on the same day) and whose
    titles ``_title_score`` gives ``TITLE`` or more, if one differs from the other by edits, by one gap, or shares a rare gram.
    """
    q = Q_JA if c == "ja" else Q_EN
    named = nodes.filter(F.length(c) > 0).select("node", "side", F.col(c).alias("text"), title_mark(c).alias("mark"), "season", "film", "year", "date")
    named = rare_grams(named, c, q, max(2, nodes.count()), shelf)
    tokens = F.explode(F.array_distinct(F.array_compact(F.concat(F.when(F.col("side") == "r", contexts(True)).otherwise(contexts(False)), F.array(_day())))))
    count = named.select("side", tokens.alias("token")).groupBy("token").agg(F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "r").alias("nr"))
    most = lambda x: F.ceil(F.col(x) / SLICE)
    count = shelf.put(count.filter("na > 0 and nr > 0").select("token", most("na").cast("int").alias("ka"), most("nr").cast("int").alias("kr"), (F.col("na") * most("nr") + F.col("nr") * most("na")).alias("rows")), f"tokens_{c}")
    rows = count.agg(F.sum("rows")).first()[0] or 0
    parts = max(2 * nodes.sparkSession.sparkContext.defaultParallelism, -(-rows // HELD))
    # a token of many titles is cut: each slice of one side meets each of the other
    own, other = (F.when(F.col("side") == "a", F.col(x)).otherwise(F.col(y)) for x, y in (("ka", "kr"), ("kr", "ka")))
    x = named.select("node", "side", "mark", "text", "rare", tokens.alias("token")).join(F.broadcast(count), "token")  # seasons, kinds, years and days
    x = x.withColumn("mine", F.pmod(F.xxhash64("node"), own)).withColumn("with", F.explode(F.sequence(F.lit(0), other - 1)))
    cell = F.when(F.col("side") == "a", F.xxhash64("token", "mine", "with")).otherwise(F.xxhash64("token", F.col("with").cast("long"), F.col("mine").cast("int")))
    x = x.select(F.pmod(cell, F.lit(parts)).cast("int").alias("p"), "node", "side", "mark", "text", "rare", "token")

    def meet(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        sides = [x[x["side"] == s] for s in "ar"]
        if not all(map(len, sides)):
            return
        a, r = (Texts(y["text"].tolist(), y["token"].to_numpy(np.int64).view(np.uint64), y["mark"].to_numpy(np.int64), y["rare"].tolist()) for y in sides)
        node, text = [y["node"].to_numpy(np.int64) for y in sides], [y["text"].to_numpy() for y in sides]
        for i, j in pairs(a, r, q):
            yield pd.DataFrame({"a": node[0][i], "r": node[1][j], f"{c}_a": text[0][i], f"{c}_r": text[1][j]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            cuts = [0, *(np.flatnonzero(np.diff(b["p"])) + 1).tolist(), len(b)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if held and i < j and held[-1]["p"].iloc[-1] != b["p"].iloc[i]:
                    yield from meet(pd.concat(held))
                    held = []
                if i < j:
                    held.append(b.iloc[i:j])
        if held:
            yield from meet(pd.concat(held))

    # edits up to what the score or a gap allows are counted in a band; most pairs leave it
    one, two = f"length({c}_a)", f"length({c}_r)"
    most = f"greatest(abs({one} - {two}), CAST(floor(greatest({one}, {two}) * {1 - TITLE / 0.85} + 1e-9) AS INT), 2)"
    near = F.expr(f"levenshtein({c}_a, {c}_r, {most}) >= 0")
    out, passes = None, max(1, -(-rows // MOVED))
    for k in range(passes):  # so what is shuffled at once doesn't grow with the titles
        some = x.filter(F.pmod("p", F.lit(passes)) == k).repartition("p").sortWithinPartitions("p")
        met = some.mapInPandas(run, f"a long, r long, {c}_a string, {c}_r string").filter(near).filter(_title_score(c)[0] >= TITLE)
        met = shelf.put(met.select("a", "r"), f"titles_{c}{k}")
        shelf.free()
        out = met if out is None else out.unionByName(met)
    return out


def candidate_edges(nodes: DataFrame, shelf: Shelf) -> DataFrame:
    """(a, r) between the sides: those of similar titles in agreeing years, or of one day."""
    out = None
    for c in ("ja", "en"):
        titles = similar_titles(nodes, c, shelf)
        shelf.drop(f"named_{c}")
        out = titles if out is None else out.unionByName(titles)
    return out.distinct()


def _title_score(c: str) -> tuple[Column, Column]:
    """(score, known) of one title: by number of edits, in proportion beyond two."""
    x, y = F.col(f"{c}_a"), F.col(f"{c}_r")
    lx, ly = F.length(x), F.length(y)
    known = (lx > 0) & (ly > 0)
    edits = F.levenshtein(x, y)
    longest = F.greatest(lx, ly)
    part = (edits == F.abs(lx - ly)) & (F.least(lx, ly) >= 3)
    ratio = 1 - edits / longest
    score = F.when(edits == 0, 1.0).when((edits == 1) & (longest >= 4), 0.95).when((edits == 2) & (longest >= 8), 0.9).when(part, F.greatest(F.lit(0.75), ratio * 0.9)).otherwise(ratio * 0.85)
    return F.when(known, score), known


def similarity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` with ``s``, the attribute similarity (about 1 for sure, below ``ACCEPT`` for no match)."""
    cols = ["ja", "en", "season", "film", "year", "date", "episodes"]
    for x in "ar":
        edges = edges.join(nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols]), x)
    (ja, has_ja), (en, has_en) = _title_score("ja"), _title_score("en")
    title = F.when(has_ja & has_en, 0.65 * F.greatest(ja, en) + 0.35 * F.least(ja, en)).when(has_ja | has_en, F.coalesce(ja, en) - 0.02).otherwise(0.0)
    gap = F.abs(F.col("year_a") - F.col("year_r"))
    year = F.when(gap == 0, 0.03).when(gap == 1, -0.06).when(gap > 1, -0.5).otherwise(-0.03)
    da, dr = F.col("date_a"), F.col("date_r")
    full = (F.length(da) == 10) & (F.length(dr) == 10)
    date = F.when(full & (da == dr), 0.12).when(full, -0.1).when((F.length(da) >= 7) & (F.length(dr) >= 7), F.when(F.substring(da, 1, 7) == F.substring(dr, 1, 7), 0.06).otherwise(-0.1)).otherwise(0.0)
    other = F.when((F.col("season_a") != F.col("season_r")) | (F.col("film_a") != F.col("film_r")), -0.15).otherwise(0.0)
    off = F.abs(F.col("episodes_a") - F.col("episodes_r"))
    eps = F.when(off == 0, 0.03).when(off <= 2, 0.0).when(off > 2, -0.08).otherwise(0.0)
    edges = edges.withColumn("s", title + year + date + other + F.coalesce(eps, F.lit(0.0)))
    return edges.filter(F.greatest(ja, en) >= TITLE).select("a", "r", "s")


def propagate(edges: DataFrame, nodes: DataFrame, shelf: Shelf) -> DataFrame:
    """``edges`` (a, r, s) with ``s`` after propagation among neighbours.

    A pair is in a group for each family of one side and its counterpart on the other: it moves
    towards the best mean of the others of a group.  Pairs alone in all their groups never move.
    A round moves nothing by more than ``PULL`` times what the last one moved, so it ends.
    """
    families = None
    for c in ("ja", "en"):
        f = nodes.filter(F.length(c) >= 3).select("node", F.xxhash64(F.lit(c), "side", c, "season", "film").alias("family"))
        families = f if families is None else families.unionByName(f)
    several = families.groupBy("family").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("family")
    families = shelf.put(families.join(several, "family", "left_semi"), "families")
    grouped = lambda x, y: edges.join(families.withColumnRenamed("node", x), x).select("a", "r", "s", F.xxhash64(F.lit(x), "family", y).alias("g"))
    group, pair = Window.partitionBy("g"), Window.partitionBy("a", "r")
    cur = grouped("a", "r").unionByName(grouped("r", "a")).withColumn("n", F.count("*").over(group)).filter("n > 1")
    cur = shelf.put(cur.select("a", "r", "g", "n", F.col("s").alias("s0"), "s"), "prop0")
    k = 0
    while True:
        new = cur.withColumn("others", (F.sum("s").over(group) - F.col("s")) / (F.col("n") - 1))
        new = new.withColumn("t", (1 - PULL) * F.col("s0") + PULL * F.max("others").over(pair))
        new = shelf.put(new.select("a", "r", "g", "n", "s0", "t", F.abs(F.col("t") - F.col("s")).alias("moved")), f"prop{k + 1}")
        moved = new.agg(F.max("moved")).first()[0]
        cur = new.select("a", "r", "g", "n", "s0", F.col("t").alias("s"))
        shelf.drop(f"prop{k}")
        k += 1
        if moved is None or moved < STABLE:
            break
    last = cur.groupBy("a", "r").agg(F.max("s").alias("t"))  # one value a pair
    return edges.join(last, ["a", "r"], "left").select("a", "r", F.coalesce("t", "s").alias("s"))


def link_records(works: DataFrame, raw: DataFrame, works_key: str, raw_key: str) -> DataFrame:
    """(works key, raw key, confidence) of the rows that describe the same entity."""
    shelf = Shelf(works.sparkSession, "linkage")
    rows = profiles(works, F.col(works_key), "a").unionByName(profiles(raw, F.col(raw_key), "r"))
    rows = shelf.put(rows.withColumn("node", F.xxhash64(*_PROFILE)), "rows")
    nodes = shelf.put(rows.select("node", *_PROFILE).distinct(), "nodes")
    member = shelf.put(rows.select("node", "key").distinct(), "member")
    shelf.drop("rows")
    shelf.free()
    scored = shelf.put(similarity(candidate_edges(nodes, shelf), nodes).filter(F.col("s") >= ACCEPT - 0.25), "scored")
    shelf.free()
    final = propagate(scored, nodes, shelf)
    pairs = final.join(member.select(F.col("node").alias("a"), F.col("key").alias("wk")), "a").join(member.select(F.col("node").alias("r"), F.col("key").alias("rk")), "r")
    pairs = pairs.groupBy("wk", "rk").agg(F.max("s").alias("s"))
    best = pairs.groupBy("rk").agg(F.max("s").alias("top"))
    out = pairs.join(best, "rk").filter((F.col("s") >= ACCEPT) & (F.col("s") >= F.least(F.col("top"), F.lit(1.0)) - NEAR))
    return out.select(F.col("wk").alias(works_key), F.col("rk").alias("raw_id"), F.least(F.lit(1.0), F.col("s")).alias("confidence"))
