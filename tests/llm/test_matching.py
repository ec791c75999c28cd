"""Co-occurrence, survivors, name clusters and record linkage on small fixtures."""

from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspark.llm import cooccur, linkage, minhash, names, survivor, titles
from reelspark.session import Shelf

CREDITS = "role string, anime_id string, person_id string, s string"


def brute_pairs(data, least, ratio):
    by = {}
    for role, w, p, _ in data:
        if role and w and w.strip() and p and p.strip():
            by.setdefault(role, {}).setdefault(w.strip().lower(), set()).add(p.strip().lower())
    out = []
    for role, works in by.items():
        n, own, c = len(works), {}, {}
        for ps in works.values():
            for p in ps:
                own[p] = own.get(p, 0) + 1
            for pair in itertools.combinations(sorted(ps), 2):
                c[pair] = c.get(pair, 0) + 1
        out += [(role, a, b, k) for (a, b), k in c.items() if k >= least and k * n >= ratio * own[a] * own[b]]
    return sorted(out)


@pytest.mark.parametrize("big", [1000, 6, 3])
def test_pairs_equal_brute_force(spark, big):
    rng = random.Random(big)
    data = [(None, "w", "p", ""), ("r", " ", "p", ""), ("r", "w", None, "")]
    for w in range(90):
        crew = {f"P{rng.randrange(60)}" for _ in range(rng.randrange(1, 5))}
        if w % 6 == 0:
            crew |= {"a", "b"}
        if w < 4:
            crew |= {f"P{i}" for i in range(40)}
        data += [("r", f" W{w}", p, "x") for p in crew] * (1 + w % 2)
        if w % 10 == 0:
            data += [("q", f"W{w}", p, "x") for p in ("a", "c")]
    df = spark.createDataFrame(data, CREDITS)
    for least, ratio in ((5, 1.0), (3, 2.0)):
        got = cooccur.together(df, "role", "anime_id", "person_id", least, ratio, big).collect()
        assert sorted((r.s, r.a, r.b, r.c) for r in got) == brute_pairs(data, least, ratio)
        assert all(0 <= r.p_value <= r.q_value <= 1 for r in got)


def test_no_credits(spark):
    assert cooccur.together(spark.createDataFrame([], CREDITS), "role", "anime_id", "person_id").collect() == []


def test_null_meets_degrees_and_tail_is_exact():
    item, items, basket, baskets = np.array([1.0, 2, 5]), np.array([10.0, 5, 2]), np.array([1.0, 3, 6]), np.array([6.0, 4, 2])
    baskets[0] = (item * items).sum() - 3 * 4 - 6 * 2
    x, y = cooccur.fit_null(item, items, basket, baskets)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose((p * baskets).sum(1), item, rtol=1e-6) and np.allclose((p * items[:, None]).sum(0), basket, rtol=1e-6)
    q, m = np.array([[0.1, 0.3, 0.02]]), np.array([3, 2, 5])
    each = [0.1] * 3 + [0.3] * 2 + [0.02] * 5
    for c in range(6):
        want = sum(np.prod([v if (k >> i) & 1 else 1 - v for i, v in enumerate(each)]) for k in range(1 << 10) if k.bit_count() >= c)
        assert abs(cooccur.tail(q, m, np.array([c]))[0] - want) < 1e-12


ROW = "group_id string, row_id string, at timestamp, source_count int, f string, f_source string"


def test_survivors(spark):
    data = [
        ("g", "1", "2020-01-01", 1, "TBA", "best"), ("g", "2", "2020-01-02", 1, "b", " Best "), ("g", "3", "2020-01-03", 1, "c", "best"), ("g", "4", "2020-01-04", 9, "d", "unlisted"),
        ("h", "1", "2020-01-01", None, "x", None), ("h", "2", None, 0, "y", "unlisted"), ("i", "1", "2020-01-01", 1, "alone", "best"),
        ("k", "1", None, 1, "new", "best"), ("k", "0", None, 1, "old", "best"), ("n", "1", None, 1, " ", "best"), ("n", "2", None, 1, None, "best"),
        *[(f"t{i}", "1", "2020-01-01", 1, "old", "best") for i in range(3)], *[(f"t{i}", "2", "2020-02-01", 1, "new", "best") for i in range(3)],
    ]
    df = spark.createDataFrame(data, ROW.replace("timestamp", "string")).selectExpr("*", "cast(at as timestamp) as t").drop("at").withColumnRenamed("t", "at")
    ranks = spark.createDataFrame([("best", 1), ("next", 2)], "source string, trust_rank int")
    got = {r.group_id: (r.from_id, r.value) for r in survivor.survivors(df, ranks, ("f",)).collect()}
    assert got == {"g": ("3", "c"), "h": ("1", "x"), "k": ("1", "new"), "t0": ("2", "new"), "t1": ("2", "new"), "t2": ("2", "new")}
    assert survivor.survivors(df.limit(0), ranks, ("f",)).collect() == []


def test_band_tuning():
    bands, rows = minhash.tune(0.45, 0.95)
    assert minhash.collision(0.45, bands, rows) >= 0.95 and bands * rows <= 96
    rng = random.Random(1)
    b, hits, n = minhash.Bander(bands, rows), 0, 300
    for _ in range(n):
        x = [f"g{rng.randrange(10**6)}" for _ in range(29)]
        y = x[:18] + [f"h{rng.randrange(10**6)}" for _ in range(11)]  # Jaccard 18 / 40
        hits += bool(set(b.keys(x).tolist()) & set(b.keys(y).tolist()))
    assert hits / n >= 0.9


def test_spellings():
    same = names.row_similarity
    s = names.spellings
    assert same(s("鶴城 颯季丸", None, None), s("颯季丸 鶴城", None, "null")) == 1.0
    assert same(s(None, "Captain Rofinfin Penima", "[]"), s(None, "PENIMA, Rofinfin", None)) == 1.0
    assert same(s(None, "Turusiro Satukimaru", None), s(None, "S. Tsurushiro", None)) >= 0.9
    assert same(s("ミペズ・ヴェエスブロ", None, None), s(None, "Mipezu Veesbro", None)) >= 0.7
    assert same(s("甲", "Foo Barson", "['Nick']"), s("乙", "Totally Different", "[\"Nick\"]")) < 0.6
    assert names.alias_list('["\\u7bdd", "b"]') == ["篝", "b"] and names.alias_list("a; b") == ["a", "b"] and names.alias_list("null") == []
    assert names.dates_clash("1990-01-02", "--01-03") and not names.dates_clash("1990", "--01-03") and not names.dates_clash(None, "x")


def test_name_clusters(spark):
    rows = [("C:1", "鶴城 颯季丸", "Satsukimaru Tsurushiro", "[]", "1986-02-15"), ("c:2", "", "S. Turusiro", None, None), ("c:3", "鶴城　颯季丸", "", "[]", None), ("c:4", "鶴城 颯季丸", "Satsukimaru Tsurushiro", "[]", "1999-09-09"), ("c:5", None, None, None, None), ("c:1", "鶴城 颯季丸", "Satsukimaru Tsurushiro", "[]", "1986-02-15")]
    cast = [("c:1", "w:1", "p:1"), (" C:2", "w:1", "p:1"), ("c:3", "w:1", "p:1"), ("c:4", "w:9", "p:9"), (None, "w:1", "p:1"), ("c:5", "w:1", "p:1"), *[(f"x:{i}", f"w:{i + 20}", f"p:{i + 20}") for i in range(30)]]
    extra = [(f"x:{i}", f"別人{i}号機", f"Other{i} Name{i}", "[]", None) for i in range(30)]
    df = spark.createDataFrame(rows + extra, "id string, name_ja string, name_en string, aliases string, date_of_birth string")
    c = spark.createDataFrame(cast, "character_id string, anime_id string, person_id string")
    got = sorted(tuple(r) for r in names.cluster_pairs(names.name_clusters(df, c)).collect())
    assert got == [("c:1", "c:2"), ("c:1", "c:3"), ("c:2", "c:3")]
    assert names.name_clusters(df.limit(0), c).collect() == []


def test_star_clusters_do_not_chain(spark):
    edges = [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("d", "e", 1.0)]
    got = {r.id: r.center for r in names.star_clusters(spark.createDataFrame(edges, "a string, b string, sim double"), Shelf(spark, "t")).collect()}
    assert got["a"] == got["b"] == got["c"] == "b" and got["d"] == got["e"]


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(names, "LIMIT", 2)
    n = 12
    df = spark.createDataFrame([(f"c:{i:02d}", "鶴城 颯季丸" if i % 2 else "鶴城 颯希丸", "", "[]", None) for i in range(n)], "id string, name_ja string, name_en string, aliases string, date_of_birth string")
    df = df.union(spark.createDataFrame([(f"y:{i:03d}", f"別人{i}号", "", "[]", None) for i in range(200)], df.schema))
    cast = spark.createDataFrame([(f"c:{i:02d}", "w:1", "p:1") for i in range(n)], "character_id string, anime_id string, person_id string")
    shelf = Shelf(spark, "t")
    ctx = names.context(df, cast)
    forms = df.select("id", "name_ja", "name_en", "aliases").mapInPandas(names._spell_rows, "id string, forms array<string>")
    pairs = {(r.a, r.b) for r in names.candidates(forms, ctx, shelf).collect()}
    reached, todo = {"c:00"}, ["c:00"]
    while todo:
        x = todo.pop()
        for a, b in pairs:
            for u, v in ((a, b), (b, a)):
                if u == x and v not in reached:
                    reached.add(v)
                    todo.append(v)
    assert len(reached) == n


def test_titles():
    core = lambda t: linkage.title_core(t, {})
    assert core("辞書 砂まみれの探偵社 第2シリーズ") == core("『辞書　砂まみれの探偵社 Ⅱ』") == core("辞書 砂まみれの探偵社 Season 2【全話】")
    assert core("劇場版 石段")[2] and core("Stone Steps The Movie")[2] and not core("石段")[2]
    assert core("The Stone Steps 2nd Season")[1] == 2 and core("")[0] == "" and core(None)[1] == 0


def test_linkage(spark):
    works = [("a:1", "青い箱庭の探偵社", "Detective Agency of the Blue Garden", 2001, 12, "2001-04-05"), ("a:2", "青い箱庭の探偵社 第2期", "Detective Agency of the Blue Garden 2", 2003, 12, "2003-04-05"), ("a:3", "青い箱庭の探偵社", "Detective Agency of the Blue Garden", 2019, 24, "2019-01-01"), ("a:4", "青い箱庭の探偵社", None, None, 12, None), ("a:5", None, "", 2001, 12, None), ("a:6", "不明", "Unknown", 2001, 12, "2001-04-05")]
    more = [(f"z:{i}", f"題名{chr(0x4E00 + 37 * i)}{chr(0x5E00 + 11 * i)}の物語", f"Tale number{i * 7919} of things", 1990 + i % 30, 12, None) for i in range(40)]
    raw = [("R1", "青い箱庭の探庭社", "Detective Agency of the Blue Garden", 2001, 12, "2001年4月5日"), ("R1", "青い箱庭の探偵社", None, 0, 12, None), ("r2", "青い箱庭の探偵社Ⅱ", None, 2003, -1, '{"year": 2003, "month": 4, "day": null}'), ("r3", None, None, 2001, 12, None), ("r4", "まったく別の話", "Something Else", 2001, 12, None)]
    schema = "{} string, title_ja string, title_en string, year int, episodes int, start_date string"
    w, r = spark.createDataFrame(works + more, schema.format("canonical_id")), spark.createDataFrame(raw, schema.format("id"))
    got = {(x.canonical_id, x.raw_id) for x in linkage.link_records(w, r, "canonical_id", "id").collect()}
    assert {("a:1", "R1"), ("a:2", "r2"), ("a:4", "R1")} <= got
    assert not {x for x in got if x[1] in ("r3", "r4") or x[0] in ("a:5", "a:6")} and ("a:3", "r2") not in got
    assert linkage.link_records(w, r.limit(0), "canonical_id", "id").collect() == []


PEOPLE = "id string, name_ja string, name_en string, aliases string, date_of_birth string"
CAST = "character_id string, anime_id string, person_id string"


def test_common_items_are_paired_whole(spark, monkeypatch):
    monkeypatch.setattr(names, "LIMIT", 2)
    one, two = ("鶴城 颯季丸", "Satsukimaru Tsurushiro"), ("鶴城 颯希丸", "Satsukimaru Tsurushira")
    rows = [("x:1", *one), ("x:2", *one), ("y:1", *two), ("y:2", *two), *[(f"z:{i}", f"別{chr(0x4E00 + 97 * i)}{chr(0x5E00 + 61 * i)}号", "") for i in range(60)]]
    df = spark.createDataFrame([(*r, "[]", None) for r in rows], PEOPLE)
    cast = spark.createDataFrame([(r[0], "w:1" if i < 12 else f"w:{i}", None) for i, r in enumerate(rows)], CAST)
    got = {tuple(r) for r in names.cluster_pairs(names.name_clusters(df, cast)).collect()}
    assert got == set(itertools.combinations(["x:1", "x:2", "y:1", "y:2"], 2))


@pytest.mark.parametrize("limit", [1000, 7, 2])
def test_candidates_equal_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(names, "LIMIT", limit)
    rng = random.Random(limit)
    syllables = ["ka", "mo", "ri", "shi", "te", "na", "ke", "n", "ro", "u", "ji", "sa"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    rows = []
    for i in range(70):
        base = rng.choice(rows)[2].split(" ") if rows and rng.random() < 0.5 else [word() for _ in range(rng.randrange(1, 4))]
        k = rng.randrange(len(base))
        base[k] = rng.choice([base[k][:1], base[k][:3], base[k][::-1], base[k] + "o", word()])
        rng.shuffle(base)
        rows.append((f"c:{i:02d}", rng.choice(["", "鶴城 颯季丸", "モリ・ケン", "もり"]), " ".join(base), "[]", rng.choice([None, "1990-01-02", "--01-02"])))
    df = spark.createDataFrame(rows, PEOPLE)
    cast = [(r[0], f"w:{i % 3}", f"p:{i % 5}") for i, r in enumerate(rows)]
    ctx = names.context(df, spark.createDataFrame(cast, CAST))
    forms = df.select("id", "name_ja", "name_en", "aliases").mapInPandas(names._spell_rows, "id string, forms array<string>")
    item, kind = {}, {}
    for r in ctx.collect():
        item.setdefault(r.id, set()).add(r.item)
        kind[r.item] = r.kind
    want = {}
    for x, y in itertools.combinations(rows, 2):
        both = item.get(x[0], set()) & item.get(y[0], set())
        least = min((names.LEAST_DAY if kind[i] == "day" else names.LEAST for i in both), default=2)
        s = names.row_similarity(names.spellings(*x[1:4]), names.spellings(*y[1:4]))
        if s >= least:
            want[x[0], y[0]] = round(s, 9)
    assert len(want) > 20
    assert {(r.a, r.b): round(r.sim, 9) for r in names.candidates(forms, ctx, Shelf(spark, "t")).collect()} == want


def people(rng, n):
    syllables = ["ka", "mo", "ri", "si", "te", "na", "ke", "ro", "u", "zi", "sa"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    kana = lambda: "".join(rng.choice("モリケンサカナテシ北村花") for _ in range(rng.randrange(1, 5)))
    rows = []
    for i in range(n):
        base = rng.choice(rows)[1].split("\n")[0].split(" ") if rows and rng.random() < 0.3 else [word() for _ in range(rng.randrange(1, 4))]
        k = rng.randrange(len(base))
        base[k] = rng.choice([base[k][:1], base[k][:3], base[k], base[k][1:] + base[k][:1], base[k] + "o"])
        rng.shuffle(base)
        forms = [" ".join(base), *([f"{kana()} {kana()}"] if i % 3 == 0 else []), *(["モリ 北"] if i % 17 == 0 else [])]
        rows.append((f"c:{i:03d}", "\n".join(forms), None if i % 5 == 0 else f"b:{1980 + i % 7}-01-02"))
    rng.shuffle(rows)
    return rows


def test_blocks_compare_few_names_and_lose_none(monkeypatch):
    rows = people(random.Random(3), 240)
    split = lambda r: [tuple(f.split(" ")) for f in r[1].split("\n")]
    sim = {(x[0], y[0]): names.row_similarity(split(x), split(y)) for x, y in itertools.combinations(sorted(rows), 2)}
    born = {r[0]: r[2] for r in rows}
    calls, plain = [0], names.monge_elkan

    def counted(a, b):
        calls[0] += 1
        return plain(a, b)

    monkeypatch.setattr(names, "monge_elkan", counted)
    for cells in (names.CELLS, 2000):
        monkeypatch.setattr(names, "CELLS", cells)
        for least in (names.LEAST, names.LEAST_DAY):
            want = {p: s for p, s in sim.items() if s >= least}
            assert len(want) > 20
            assert {(a, b): s for a, b, s in names._alike(rows, None, least)} == want
            one, two = rows[:90], rows[90:]
            across = {p: s for p, s in want.items() if (p[0] in {r[0] for r in one}) != (p[1] in {r[0] for r in one})}
            assert {(a, b): s for a, b, s in names._alike(one, two, least)} == across
        # of one day, rows with different years link by equal names only, and those of one birth date are another item's pairs
        clash = lambda a, b: born[a] and born[b]
        calls[0] = 0
        day = {(a, b): s for a, b, s in names._same_day(rows, None)}
        assert day == {(a, b): s for (a, b), s in sim.items() if s >= (1.0 if clash(a, b) else names.LEAST_DAY)}
        assert calls[0] < 0.1 * len(sim)


def test_edits_equal_plain_table():
    def plain(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return 1.0 - d[len(a), len(b)] / max(len(a), len(b))

    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abcあ") for _ in range(rng.randrange(1, 11))) for _ in "ab")
        assert names._edit(a, b) == plain(a, b)


def test_days_of_different_years_give_equal_names_only(spark, monkeypatch):
    monkeypatch.setattr(names, "LIMIT", 3)
    rows = [("c:1", "Kenziro Morino", "1990-01-02"), ("c:2", "Morino Kenziro", "1991-01-02"), ("c:3", "Kenziro Morina", "1992-01-02"), ("c:4", "Kenziro Morina", "--01-02")]
    rows += [(f"z:{i:02d}", f"別{chr(0x4E00 + 97 * i)}{chr(0x5E00 + 61 * i)}号", "--01-02") for i in range(20)] + [("y:1", "別人", None)]
    df = spark.createDataFrame([(i, n, "", "[]", d) for i, n, d in rows], PEOPLE)
    cast = spark.createDataFrame([], CAST)
    forms = df.select("id", "name_ja", "name_en", "aliases").mapInPandas(names._spell_rows, "id string, forms array<string>")
    got = {(r.a, r.b) for r in names.candidates(forms, names.context(df, cast), Shelf(spark, "t")).collect()}
    assert got == {("c:1", "c:2"), ("c:1", "c:4"), ("c:2", "c:4"), ("c:3", "c:4")}


def test_common_items_support_links(spark):
    n = 300
    name = lambda i: f"別{chr(0x4E00 + 97 * i)}{chr(0x5E00 + 31 * i)}{chr(0x6E00 + 17 * i)}号"
    known = {0: ("鶴城 颯季丸", ""), 1: ("鶴城 颯季丸", ""), 2: ("", "Kenjiro Morino Hanasaki"), 3: ("", "K. Morino H."), 298: ("鶴城 颯季丸", ""), 299: ("", "Kenjiro Morino Hanasaki")}
    df = spark.createDataFrame([(f"c:{i:03d}", *known.get(i, (name(i), "")), "[]", None) for i in range(n)], PEOPLE)
    # a third of all rows has voice p:hot, the rows 2 to 101 also work w:hot, and every row w:all
    cast = [(f"c:{i:03d}", "w:hot" if 2 <= i < 102 else None, "p:hot" if i < 100 else None) for i in range(n)] + [(f"c:{i:03d}", "w:all", None) for i in range(n)]
    cast = spark.createDataFrame(cast, CAST)
    w = {r.item: r.w for r in names.context(df, cast).collect()}
    assert set(w) == {"v:p:hot", "w:w:hot"} and all(0.15 < x < 0.25 for x in w.values())
    shelf = Shelf(spark, "t")
    got = {(r.a, r.b): round(r.support, 6) for r in names.links(df, cast, shelf).collect()}
    assert got == {("c:000", "c:001"): round(w["v:p:hot"], 6), ("c:002", "c:003"): round(sum(w.values()), 6)}


def test_initials_are_found_in_items_of_any_size(spark):
    n = 1100
    pairs = [("Kenichiro Masatoshi Takeshi", "K. M. T."), ("Hanasaki Morino", "H. Mo"), ("Aleksander Wolkow", "Aleks Wol")]
    rows = [(f"x:{i}{k}", "", p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
    rows += [(f"z:{i:04d}", f"別{chr(0x4E00 + 7 * i)}{chr(0x5E00 + 3 * i)}{chr(0x6E00 + 5 * i)}号", "") for i in range(n)]
    df = spark.createDataFrame([(*r, "[]", None) for r in rows], PEOPLE)
    for size in (6, n):
        cast = spark.createDataFrame([(r[0], "w:1", None) for r in rows[:size]] + [(r[0], "w:2", None) for r in rows[-3:]], CAST)
        forms = df.select("id", "name_ja", "name_en", "aliases").mapInPandas(names._spell_rows, "id string, forms array<string>")
        got = {(r.a, r.b) for r in names.candidates(forms, names.context(df, cast), Shelf(spark, f"t{size}")).collect()}
        assert {(f"x:{i}0", f"x:{i}1") for i in range(3)} <= got


def test_precedence_is_closed_over_chains_and_cycles(spark):
    order = [("f", "a", "b"), ("f", "b", "c"), ("f", "c", "d"), ("f", "d", "b"), ("f", "d", "e"), ("f", "x", "e"), ("g", "a", "z")]
    got = {(r.field_name, r.value): r.level for r in survivor.currency_levels(spark.createDataFrame(order, "field_name string, old string, new string"), Shelf(spark, "t")).collect()}
    assert got[("f", "b")] == got[("f", "c")] == got[("f", "d")] == 1
    assert (got[("f", "a")], got[("f", "x")], got[("f", "e")], got[("g", "a")], got[("g", "z")]) == (0, 0, 2, 0, 1)
    assert survivor.currency_levels(spark.createDataFrame([], "field_name string, old string, new string"), Shelf(spark, "t")).collect() == []


def test_latest_value_without_timestamps_goes_over_a_chain(spark):
    from datetime import datetime

    # a -> b and b -> c are learned from stamped groups; the bare group holds only a and c
    rows = [(g, f"{g}{v}", 1, datetime(2020, 1, i + 1), v, "s") for g, p in (("g1", "ab"), ("g2", "bc")) for i, v in enumerate(p)]
    rows += [("g3", "1", 1, None, "a", "s"), ("g3", "2", 1, None, "c", "s")]
    df = spark.createDataFrame(rows, "group_id string, row_id string, source_count int, at timestamp, f string, f_source string")
    ranks = spark.createDataFrame([("s", 1)], "source string, trust_rank int")
    usable = lambda c: {r.group_id: r.value for r in survivor.survivors(df, ranks, ("f",), currency=c).collect()}["g3"]
    assert usable(True) == "c" and usable(False) == "a"


def test_wide_degree_classes_change_little(spark, monkeypatch):
    classes = [("r", side, k, 60) for side in ("item", "basket") for k in range(1, 40)]
    df = spark.createDataFrame(classes, "s string, side string, degree long, count long")
    exact = {(r.side, r.degree): r.fit for r in cooccur.fitted_classes(df).collect()}
    monkeypatch.setattr(cooccur, "EXACT", 20)
    rough = cooccur.fitted_classes(df).collect()
    assert len(exact) == len(classes) and all(abs(r.fit / exact[r.side, round(r.degree)] - 1) < 0.03 for r in rough)


def test_title_candidates_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        ja = "".join(chr(0x4E00 + rng.randrange(40)) for _ in range(rng.choice([3, 4, 6, 12, 15])))
        en = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice([5, 13, 30, 45, 150])))
        for side in "ar":
            j, e = list(ja), list(en)
            if side == "r":
                for t in (j, e):
                    for _ in range(rng.randrange(0, max(2, len(t) // 5))):
                        t[rng.randrange(len(t))] = rng.choice("三四五xyz")
                if i % 4 == 0:  # shortened by one gap
                    k = rng.randrange(1, 3)
                    j, e = j[:k] + j[-2:], e[: 2 * k] + e[-3:]
            rows.append((side, "".join(j), "".join(e)))
    rows += [("a", "青い箱庭の探偵社物語集", ""), ("r", "青い猫庭の探偵者物語集", ""), ("a", "", "bluegardenags"), ("r", "", "bluegaxdenags")]
    nodes = spark.createDataFrame([(i, *r, 1, False, None, None) for i, r in enumerate(rows)], "node long, side string, ja string, en string, season int, film boolean, year int, date string").cache()
    pairs = nodes.filter("side = 'a'").crossJoin(nodes.filter("side = 'r'").select(*[nodes[c].alias(f"{c}_r") for c in ("node", "ja", "en")])).withColumnsRenamed({"node": "a", "node_r": "r", "ja": "ja_a", "en": "en_a"})

    def one_gap(x, y):
        x, y = sorted((x, y), key=len)
        return len(x) >= 3 and any(y.startswith(x[:k]) and y.endswith(x[k:]) for k in range(len(x) + 1))

    want = set()
    for c in ("ja", "en"):
        near = pairs.filter(linkage._title_score(c)[0] >= linkage.TITLE)
        for x in near.select("a", "r", f"{c}_a", f"{c}_r", F.levenshtein(f"{c}_a", f"{c}_r")).collect():
            if x[4] <= linkage.most_edits(max(len(x[2]), len(x[3]))) or one_gap(x[2], x[3]):
                want.add((x[0], x[1]))
    got = {tuple(x) for x in linkage.candidate_edges(nodes, Shelf(spark, "t")).select("a", "r").collect()}
    assert len(want) > 50 and not [(rows[a], rows[r]) for a, r in want - got]


def test_titles_are_shuffled_not_their_keys(spark):
    rng = random.Random(9)
    rows = [(i, "ar"[i % 2], "".join(chr(0x4E00 + rng.randrange(400)) for _ in range(12)), "".join(rng.choice("abcdefghijklmnop") for _ in range(32)), 1, False, 2000 + rng.randrange(8), None) for i in range(4000)]
    nodes = spark.createDataFrame(rows, "node long, side string, ja string, en string, season int, film boolean, year int, date string")

    def written():
        sc = spark.sparkContext._jsc.sc()
        spark.range(10).count()
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).head().totalShuffleWrite()

    before = written()
    linkage.candidate_edges(nodes, Shelf(spark, "t")).count()
    assert written() - before < 12 * sum(len(x[2].encode()) + len(x[3]) for x in rows)


@pytest.mark.parametrize("limit", [1000, 7])
def test_slices_of_a_year_lose_no_pair(spark, monkeypatch, limit):
    monkeypatch.setattr(linkage, "SLICE", limit)  # a year in one piece, or slices of each side that meet all of the other
    monkeypatch.setattr(linkage, "HELD", 3 * limit)
    monkeypatch.setattr(linkage, "MOVED", 60 * limit)
    monkeypatch.setattr(linkage, "GRAMS", 80 * limit)
    rng = random.Random(3)
    rows = []
    for i in range(60):
        ja = "".join(chr(0x4E00 + rng.randrange(30)) for _ in range(9))
        year = rng.choice([None, 1999, 2000, 2001, 2004])
        day = rng.choice([None, "2000-01-02", "2004-05-06"])
        rows += [("a", ja, "", 1, i % 9 == 0, year, day), ("r", ja[:4] + "三" + ja[5:], "", rng.choice([1, 1, 2]), i % 9 == 0, rng.choice([None, year, 2000]), day), ("r", ja[::3] + ja[7], "", 1, False, year, None)]
    nodes = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "node long, side string, ja string, en string, season int, film boolean, year int, date string").cache()
    fits = lambda x, y: (x[3:5] == y[3:5] and (x[5] is None or y[5] is None or abs(x[5] - y[5]) <= 1)) or (x[6] is not None and x[6] == y[6])
    plain = lambda x, y: len(x) == len(y) and sum(a != b for a, b in zip(x, y, strict=True)) <= 1
    want = {(i, j) for i, x in enumerate(rows) for j, y in enumerate(rows) if x[0] == "a" and y[0] == "r" and fits(x, y) and plain(x[1], y[1])}
    got = {tuple(x) for x in linkage.candidate_edges(nodes, Shelf(spark, "t")).collect()}
    assert len(want) > 30 and want <= got and all(fits(rows[i], rows[j]) for i, j in got)


def test_title_marks_spare_no_alike_titles(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdeあ") for _ in range(rng.randrange(1, 24))) for _ in range(60)]
    texts += [t[:k] + rng.choice("xyz") + t[k + rng.randrange(3) :] for t in texts for k in [rng.randrange(len(t))]] + ["q" * 300, "q" * 299 + "r"]
    x = spark.createDataFrame([(t,) for t in texts], "ja_a string")
    pairs = x.crossJoin(x.withColumnRenamed("ja_a", "ja_r")).withColumn("m", linkage.title_mark("ja_a")).withColumn("k", linkage.title_mark("ja_r"))
    got = pairs.select((linkage._title_score("ja")[0] >= linkage.TITLE).alias("alike"), linkage.may_agree("m", "k").alias("may")).groupBy("alike", "may").count().collect()
    n = {(r.alike, r.may): r["count"] for r in got}
    assert (True, False) not in n and n[True, True] > 100 and n[False, False] > 2 * n[False, True]


def test_marks_on_arrays_equal_marks_in_plans(spark):
    rng = random.Random(4)
    texts = ["", *("".join(rng.choice("abcd三四五") for _ in range(rng.choice([1, 3, 5, 9, 40, 300]))) for _ in range(40))]
    x = spark.createDataFrame([(t,) for t in texts if t], "t string").withColumn("m", linkage.title_mark("t"))
    got = x.select("m").crossJoin(x.select(F.col("m").alias("k"))).withColumn("may", linkage.may_agree("m", "k")).collect()
    assert titles.may_agree(np.array([g.m for g in got]), np.array([g.k for g in got])).tolist() == [g.may for g in got]


def test_propagation_equals_plain_rounds(spark):
    rng = random.Random(8)
    nodes = [(i, "a" if i < 12 else "r", rng.choice(["", "xxx", "yyy", "zzz"]), rng.choice(["", "uuu", "vvv"]), 1, False) for i in range(24)]
    edges = [(a, r, round(rng.uniform(0.5, 1.0), 3)) for a in range(12) for r in range(12, 24) if rng.random() < 0.4]
    family = {n[0]: [(c, n[1], t) for c, t in (("ja", n[2]), ("en", n[3])) if t] for n in nodes}
    s0 = {(a, r): s for a, r, s in edges}
    cur = dict(s0)
    while True:
        new = {}
        for a, r in s0:
            pull = []
            for mine, other, pair in [(a, r, lambda x, r=r: (x, r)), (r, a, lambda x, a=a: (a, x))]:
                for f in family[mine]:
                    near = [cur[pair(x)] for x in family if x != mine and f in family[x] and pair(x) in cur]
                    pull += [sum(near) / len(near)] if near else []
            new[a, r] = (1 - linkage.PULL) * s0[a, r] + linkage.PULL * max(pull) if pull else s0[a, r]
        moved = max(abs(new[e] - cur[e]) for e in new)
        cur = new
        if moved < linkage.STABLE:
            break
    got = linkage.propagate(spark.createDataFrame(edges, "a long, r long, s double"), spark.createDataFrame(nodes, "node long, side string, ja string, en string, season int, film boolean"), Shelf(spark, "t"))
    got = {(x.a, x.r): x.s for x in got.collect()}
    assert got.keys() == cur.keys() and all(abs(got[e] - cur[e]) < 1e-9 for e in cur)


def test_shuffles_of_written_tables_are_let_go(spark):
    def kept():
        m = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {b.name() for b in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(m.getAllBlocks()) if b.name().startswith("shuffle_")}

    before, shelf = kept(), Shelf(spark, "t")
    shelf.put(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "x")
    mine = kept() - before
    assert mine
    shelf.put(spark.range(10), "y")  # the last job's stages stay known to the scheduler
    shelf.free()
    for _ in range(50):
        if not mine & kept():
            break
        time.sleep(0.2)
    assert not mine & kept()
