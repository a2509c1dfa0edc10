import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pieces as P


def whole(text, limit=50, overlap=10):
    got = P.pieces(text, limit, overlap)
    assert "".join(text[b:e] for _, b, e in got) == text
    assert all(0 <= a <= b < e and e - a <= limit for a, b, e in got)
    assert all(p[2] == q[1] and q[0] >= p[0] for p, q in zip(got, got[1:]))
    return got


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .,\n日😀é́", max_size=400))
def test_pieces_are_the_text(text):
    whole(text)


def test_cuts_fall_on_the_strongest_boundaries():
    text = "One short sentence here. Another one there.\n\nA new paragraph begins. It ends."
    assert [text[b:e] for _, b, e in whole(text, 60, 10)] == ["One short sentence here. Another one there.\n\n", "A new paragraph begins. It ends."]


def test_overlap_starts_at_a_word():
    text = "alpha beta gamma delta. " * 20
    got = whole(text, 100, 20)
    for a, b, _ in got[1:]:
        assert 10 <= b - a <= 30 and text[a - 1].isspace() and not text[a].isspace()


def test_unbroken_stretches():
    got = whole("x" * 130, 50, 10)
    assert [(b - a) for a, b, _ in got[1:]] == [10] * (len(got) - 1)
    assert whole("x" * 50) == [(0, 0, 50)]
    text = "é" * 60
    assert all(text[b] != "́" for _, b, _ in whole(text))


def test_very_long_text_is_handled_whole():
    text = ("word " * 30 + ".\n") * 10_000
    got = P.pieces(text)
    assert got[-1][2] == len(text) and all(e - a <= 1800 for a, _, e in got)


def test_split(spark):
    rows = [("a", "y" * 1801, 1), ("b", "ok " * 700, 2), ("c", "short", 3), ("d", "", 4), ("e", None, 5), (None, "z" * 2000, 6), ("a", "y" * 1801, 7)]
    df = spark.createDataFrame(rows, "id string, text string, key int")
    got = P.split(df, "id", "text").collect()
    by = {}
    for r in got:
        by.setdefault(r["key"], []).append(r)
    assert set(by) == {"a", "b", "c"} and [r["forced"] for r in by["a"]] == [1] * len(by["a"]) and not any(r["forced"] for r in by["b"] + by["c"])
    assert [r["piece_id"] for r in by["b"]] == [f"b#c{i}" for i in range(len(by["b"]))]
    assert all(len(r["piece_text"]) == r["core_end"] - r["piece_start"] <= 1800 for r in got)
    assert P.split(df.limit(0), "id", "text").count() == 0


def test_latest(spark):
    df = spark.createDataFrame([(1, "a", 5, "old"), (2, "a", None, "none"), (3, "a", 6, "new"), (4, "b", 1, "only"), (5, None, 1, "x")], "row bigint, id string, t int, text string")
    assert sorted((r["id"], r["text"]) for r in P.latest(df, "id", ["t", "row"]).collect()) == [("a", "new"), ("b", "only")]


def test_forced_means_a_stretch_over_the_limit():
    assert re.search(r"\S{1801,}", "x" * 1801) and not re.search(r"\S{1801,}", "x" * 1800)


def test_a_long_sentence_leaves_room_for_the_overlap():
    # Sentences of 46 to 50 characters behind the first piece, over 50 less 10.
    text = "Short start of a text here now. " + "word, " * 7 + "last. " + "and some more words that go on until here end. " + "x" * 50 + " end"
    got = whole(text)
    assert all(b - a >= 5 for a, b, _ in got[1:])
