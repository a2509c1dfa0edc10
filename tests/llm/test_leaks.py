import random

import numpy as np

from tidemark.llm import leaks as K


def test_index_against_scanning():
    rng = np.random.default_rng(5)
    for _ in range(20):
        text = rng.integers(0, 4, int(rng.integers(1, 200)))
        index = K.FMIndex(text)
        phrases = [text[i : i + n] for n in (1, 2, 5) for i in rng.integers(0, len(text), 3) if i + n <= len(text)] + [np.array([9, 1]), np.array([3, 3, 3])]
        width = max(map(len, phrases))
        rows = np.array([np.concatenate([np.zeros(width - len(p), np.int64), p]) for p in phrases])
        low, high = index.search(rows, np.array([len(p) for p in phrases]))
        for p, a, b in zip(phrases, low, high):
            expected = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


ITEM = "Why does Zedport keep refusing quota tokens from Rholume although Junport signed them 23 minutes ago?"


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id bigint, text string, item_id string")
    m = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((r["doc_id"], r["item_id"], r["word_from"], r["word_to"]) for r in K.leaks(d.select("doc_id", "text"), "doc_id", "text", m, "item_id", "text").collect())


def test_passages_however_they_are_dressed(spark):
    words = ITEM.split()
    docs = [
        (1, "before " + ITEM + " after"),
        (2, "x " + " ".join(words[1:13]).upper()),
        (3, " ".join(words[:11])),
        (4, ITEM.replace("keep", "**keep**,").replace("quota", "<b>quota</b>").replace("refusing", "re­fusing")),
        (5, ITEM.replace("o", "о").replace("W", "Ｗ")),
        (6, ITEM.replace("tokens", "coins")),
        (7, None), (8, ""), (9, "short item, whole!"), (10, "short item only"),
        (11, " ".join(words[:7]) + " gap " + " ".join(words[7:])),
        (12, ITEM + " - and again - " + ITEM),
    ]
    got = found(spark, docs, [(1, ITEM), (2, "Short item whole"), (3, ""), (4, None), (5, "?!"), (6, ITEM)])
    spans = [(d, i, a, b) for d, a, b in [(1, 1, 17), (2, 1, 13), (4, 0, 16), (5, 0, 16), (12, 0, 16), (12, 18, 34)] for i in (1, 6)]
    assert got == sorted([*spans, (9, 2, 0, 3)])
    assert found(spark, [], [(1, ITEM)]) == [] and found(spark, docs, []) == []


def test_against_scanning_windows(spark):
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 40)))) for i in range(15)]
    docs = []
    for d in range(60):
        words = rng.choices([*vocabulary, "other", "words"], k=rng.randint(0, 80))
        if d % 2:
            part = rng.choice(items)[1].split()
            at = rng.randrange(len(part))
            words[5:5] = part[at : at + rng.randint(8, 16)]
        docs.append((d, " ".join(words)))
    expected = set()
    for d, text in docs:
        w = text.split()
        for i, item in items:
            x = item.split()
            n = min(12, len(x))
            grams = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
            if any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1)):
                expected.add((d, i))
    assert {(d, i) for d, i, _, _ in found(spark, docs, items)} == expected


def test_a_very_long_document(spark):
    assert [r[:2] for r in found(spark, [(1, "why does " * 50_000 + ITEM)], [(1, ITEM)])] == [(1, 1)]


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(K, "GROUP_CHARS", 60)
    assert [r[:2] for r in found(spark, [(1, ITEM + " and " + ITEM[::-1])], [(1, ITEM), (2, ITEM[::-1])])] == [(1, 1), (1, 2)]


def test_removal_spans(spark):
    df = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 4, 9), (1, 2, 9, 10), (1, 3, 20, 25), (2, 1, 3, 4)], "doc_id bigint, item_id bigint, word_from bigint, word_to bigint")
    got = {r["doc_id"]: ([tuple(s) for s in r["spans"]], r["n_items"]) for r in K.removal_spans(df, "doc_id").collect()}
    assert got == {1: ([(0, 10), (20, 25)], 3), 2: ([(3, 4)], 1)}


def test_markup_of_any_length(spark):
    words = ITEM.split()
    dress = lambda between: " ".join(words[:6]) + between + " ".join(words[6:])
    docs = [
        (1, dress(f' <a href="{"x" * 300}"> ')), (2, dress(" <!-- a note -->")), (3, dress(f"<!-- {'-- <b> ' * 5000} -->")), (4, dress(" ](http://example.invalid/a(b ")), (5, "[" + dress("](http://example.invalid/long/target) ")),
        (6, dress("&nbsp;&#160;&#xA0;&CounterClockwiseContourIntegral;")), (7, dress(" <!-- never closed ")), (8, dress(" x < y ")), (9, "<!--" * 50_000 + ITEM),
    ]
    assert [r[0] for r in found(spark, docs, [(1, ITEM)])] == [1, 2, 3, 5, 6, 9]


def test_more_items_than_one_group_holds(spark, monkeypatch):
    monkeypatch.setattr(K, "GROUP_CHARS", 12)
    docs = [(1, "one two three"), (2, "three four"), (3, "none")]
    items = [(1, "one two"), (2, "two three"), (3, "three four"), (4, "four five"), (5, ""), (6, None)]
    assert [r[:2] for r in found(spark, docs, items)] == [(1, 1), (1, 2), (2, 3)]
