import math
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import lookalike as L

SAME = [
    ("office", "oﬃce"), ("file", "ﬁle"), ("abc", "ａｂｃ"), ("a b", "a b"), ("a b", "a　b"), ("a  b", "a  b"),
    ("queue", "que​ue"), ("queue", "﻿qu­eue⁠"), ("café", "café"), ("well-known", "well‑known"), ("scope", "ѕсоре"), ("Tokyo", "Τоkyо"),
    ("время", "вpeмя"), ("ёлка", "ёлка"), ("ガ", "ｶﾞ"), ("Host", "Ηоѕt"), ("ёж", "ëж"), ("go", "ɡօ"), ("Act", "Ꭺct"), ("Oslo", "Ⲟslⲟ"), ("a", "ɑ"), ("a-b", "a−b"),
]
DIFFERENT = [("Abc", "abc"), ("a b", "a  b"), ("cafe", "café"), ("x2", "x²"), ("a1", "al"), ("a-b", "a–b"), ("a b", "a\tb"), ("½", "1/2"), ("①", "1"), ("don't", "don’t")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_equal_looks(a, b):
    forms = L.Forms()
    assert forms(a) == forms(b)
    assert L.caseless(a) == L.caseless(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different_looks(a, b):
    forms = L.Forms()
    assert forms(a) != forms(b)


def test_tokens_keep_one_script():
    forms = L.Forms({("cyrillic", "^", "с"): -1.0, ("latin", "^", "c"): -2.0})
    assert forms("сервер вернул oтвeт") == "сервер вернул ответ"
    assert forms("сбой pop-nоrth") == "сбой pop-north"
    assert forms("scоpе only") == "scope only"
    assert forms("👨‍👩 café") == "👨‍👩 café"


def test_the_counts_decide_about_the_script():
    # The last letters can be of either script; what follows in each of them decides.
    letters = {("cyrillic", "^", "в"): -1.0, ("cyrillic", "в", "о"): -1.0, ("cyrillic", "о", "р"): -1.0, ("latin", "^", "o"): -6.0, ("latin", "o", "p"): -0.1}
    assert L.Forms({**letters, ("switch", "", ""): -9.0})("вop") == "вор"
    assert L.Forms({**letters, ("latin", "^", "o"): -0.1, ("cyrillic", "в", "о"): -12.0, ("switch", "", ""): -1.0})("вop") == "вop"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FFFF, exclude_categories=["Cs"]), max_size=30))
def test_forms_are_stable_and_composed(text):
    forms = L.Forms()
    form = forms(text)
    assert forms(form) == form and unicodedata.is_normalized("NFC", form)
    # The short way around texts without special characters changes nothing.
    if not L._SPECIAL.search(text):
        assert unicodedata.normalize("NFC", L.shape(text)) == text


@settings(max_examples=100, deadline=None)
@given(st.data())
def test_disguises_are_undone(data):
    text = data.draw(st.text(alphabet="abcdehijopsxyz ABCEHKMOPTX мир-é", max_size=25))
    out = []
    for ch in text:
        twins = L.TWINS.get(ch, "")
        out.append(data.draw(st.sampled_from([ch, *twins])) + data.draw(st.sampled_from(["", "", "​", "­"])))
    forms = L.Forms()
    assert forms("".join(out)) == forms(text)


def test_pairs(spark):
    rows = [(1, "the scope"), (2, "the scope"), (3, "the ѕcope"), (4, "the scope"), (5, "The scope"), (6, None), (7, ""), (8, "​"), (None, "the scopе"), (3, "the ѕcope")]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id bigint, text string, hi int, stored int")
    got = sorted(tuple(r) for r in L.equal_looking(df, "doc_id", "text").collect())
    assert got == [(1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (7, 8)]
    assert L.equal_looking(df.limit(0), "doc_id", "text").count() == 0


def test_forms_as_a_column(spark):
    df = spark.createDataFrame([("ѕcope", "old"), (None, "x"), ("x" * 200_000 + "ａ", "y")], "text string, form string")
    out = L.consistent(df, "text").collect()
    assert [r["form"] if r["form"] is None else r["form"][-5:] for r in out] == ["scope", None, "xxxxa"]


def test_bigrams_count_everything(spark):
    df = spark.createDataFrame([("ab ab",), ("Аб аб",), ("aб",), (None,), ("",)], "text string")
    model = L.bigrams(df, "text")
    assert model[("switch", "", "")] == pytest.approx(math.log(2 / 7))
    assert set(model) - {("switch", "", "")} == {("latin", "^", "a"), ("latin", "a", "b"), ("cyrillic", "^", "а"), ("cyrillic", "а", "б")}
