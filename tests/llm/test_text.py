"""Visual forms, tokens, mixing and shared spans against brute force."""

from __future__ import annotations

import random

import pytest

from reelspark.llm import mixing, spans, tokens, visual

TEXTS = ["", "abc", "it's 12 o'clock!!  \n\n x", "東京の空。とても 青い", "'sx 'll !'s", "a" * 300, "ab1" * 200, "<|endoftext|> x", "é́ 한국어 텍스트 　 x", " " * 70 + "x", "don't " * 90, "x\n" * 100 + "'re", "😀😀👍🏽 emoji"]


def test_tree_encoding_equals_plain_encoding():
    enc = tokens.encoding(tokens.vocabulary())
    one = tokens._encoder(tokens.vocabulary())
    rng = random.Random(5)
    alphabet = "ab 1'\n.s東é!　"
    more = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    for t in TEXTS + more:
        for leaf in (1, 3, 17, 4096):
            got = tokens.encode_tree(t, leaf, one).tolist() if t else []
            assert got == enc.encode_ordinary(t), (t, leaf)
        assert tokens.decode(enc.encode_ordinary(t)).decode() == t


def test_documents_agree_with_the_other_library(spark):
    lib = pytest.importorskip("tokenizers")
    t = lib.Tokenizer.from_file(tokens.TOKENIZER_DIR + "/byte_bpe_50k.json")
    t.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate([None, *TEXTS])), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokens.encode_documents(df, ["doc_id"], leaf=16).collect()}
    assert got == {i: [] if x is None else t.encode(x, add_special_tokens=False).ids for i, x in enumerate([None, *TEXTS])}
    assert tokens.encode_documents(df.limit(0), ["doc_id"]).collect() == []


def test_visual_pairs(spark):
    data = [("t", "1", "カメラ"), ("t", "2", "ｶﾒﾗ"), ("t", "3", "力メラ"), ("t", "4", "かめら"), ("t", "5", "A  b"), ("t", "6", "А　b​ "), ("t", "7", "a b"), ("t", "8", "Ab"), ("t", "9", None), ("t", "a", " "), ("t", "b", "​"), ("t", "c", "カメラ"), ("u", "1", "ｶﾒﾗ"), ("t", "d", "が"), ("t", "e", "が")]
    df = spark.createDataFrame([(*r, 0) for r in data], "table_name string, id string, text string, form int")
    got = sorted(tuple(r) for r in visual.lookalike_pairs(df).collect())
    want = [("t", "1", "2"), ("t", "1", "3"), ("t", "2", "3"), ("t", "2", "c"), ("t", "3", "c"), ("t", "5", "6"), ("t", "d", "e")]
    assert got == want
    loose = {tuple(r) for r in visual.lookalike_pairs(df, fold_case=True).collect()}
    assert ("t", "5", "7") in loose
    classes = {(r.table_name, r.id): r.class_id for r in visual.visual_classes(df).collect()}
    assert classes["t", "c"] == classes["t", "3"] == "1" and ("t", "9") not in classes and ("t", "a") not in classes
    assert visual.lookalike_pairs(df.limit(0)).collect() == []


def brute_spans(docs, n):
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - n + 1):
            where.setdefault(t[i : i + n], set()).add(d)
    out = []
    for d, t in docs:
        hit = [False] * len(t or "")
        for i in range(len(t or "") - n + 1):
            if len(where[t[i : i + n]]) > 1:
                hit[i : i + n] = [True] * n
        i = 0
        while i < len(hit):
            if hit[i]:
                j = i
                while j < len(hit) and hit[j]:
                    j += 1
                out.append((d, i, j))
                i = j
            else:
                i += 1
    return sorted(out)


@pytest.mark.parametrize(("n", "first"), [(16, 4), (12, 12), (20, 5)])
def test_spans_equal_brute_force(spark, n, first):
    rng = random.Random(n)
    word = lambda k: "".join(rng.choice("abcde東京😀") for _ in range(k))
    passages = [word(n + rng.randrange(0, 25)) for _ in range(8)]
    docs = []
    for i in range(60):
        parts = [word(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 4)
            parts += [p[a:], word(rng.randrange(0, 12))]
        docs.append((i, "".join(parts)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, None), (103, ""), (104, "ab" * 40), (105, "ba" * 40), (106, "x" * 90)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, part int")
    got = spans.shared_spans(df, min_len=n, first=first).collect()
    assert sorted((r.doc_id, s.start, s.end) for r in got for s in r.spans) == brute_spans(docs, n)
    assert all(r.shared_chars == sum(s.end - s.start for s in r.spans) for r in got)


def test_very_long_texts(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abc def東京。") for _ in range(300_000))
    texts = [long, "a" * 60_000, long[1000:250_000] + "!", " " * 9000 + "x"]
    enc = tokens.encoding(tokens.vocabulary())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokens.encode_documents(df, ["doc_id"]).collect()}
    assert all(got[i] == enc.encode_ordinary(t) for i, t in enumerate(texts))
    found = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in spans.shared_spans(df).collect()}
    assert found == {0: [(1000, 250_000)], 2: [(0, 249_000)]}
    assert len(visual.visual_form(long, {})) > 200_000


def test_spans_of_nothing(spark):
    df = spark.createDataFrame([(1, "short"), (2, None)], "doc_id long, text string")
    assert spans.shared_spans(df).collect() == []


def test_mix(spark):
    docs = [(i, "one two three four " * (1 + i % 5), " Big" if i % 2 else "BIG ") for i in range(300)] + [(1000 + i, "word " * 20, "small-one") for i in range(4)] + [(2000, "x", None), (2001, None, "big"), (2002, "y", "other")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.6, 2), ("small_one", 0.4, 3), ("none", 0.1, 5), (None, 0.1, 5)], "source string, target_share double, max_repeats int")
    shares = {r.source: r for r in mixing.mix_shares(df, targets).collect()}
    assert shares["small_one"].most_copies == 3 and shares["small_one"].rows == 12
    assert shares["none"].actual_share == 0.0 and shares["none"].n_docs == 0
    assert abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9
    want = 0.6 * sum(r.available for r in shares.values())
    assert abs(shares["big"].tokens - want) / want < 0.05
    got = mixing.mix(df, targets).collect()
    assert len({(r.doc_id, r.copy_no) for r in got}) == len(got) == sum(r.rows for r in shares.values())
    assert not {2000, 2002} & {r.doc_id for r in got}
    assert mixing.mix(df.limit(0), targets).collect() == []
