import os

import pytest

from tidemark.llm import mixing as M
from tidemark.session import written

DOC = "doc_id bigint, source string, lang string, n_tokens bigint"
MIX = "mix_id int, source string, target_share double, max_repeats int, total_ratio double"


def run(spark, docs, mixes, domains=None):
    sized = spark.createDataFrame(docs, DOC)
    parts = written(M.plan(sized, spark.createDataFrame(mixes, MIX), domains or {}), "budgets")
    return parts.collect(), M.choose(sized, parts, "doc_id").collect()


def tokens(rows, mix, source):
    return sum(r["n_tokens"] * r["repeats"] for r in rows if r["mix_id"] == mix and r["source"] == source)


def test_filling():
    assert M._fill(10, [1, 1], [100, 100]) == [5, 5]
    assert M._fill(10, [1, 1], [2, 100]) == [2, 8]
    assert M._fill(10, [1, 1, 2], [1, 1, 1]) == [1, 1, 1]
    assert M._fill(10, [0, 1], [100, 3]) == [0, 3]


def test_shortages_go_to_siblings_before_other_branches():
    leaf = lambda d, s, w, c: {"domain": d, "source": s, "weight": w, "cap": c}
    got = M.budget([leaf("x", "a", 0.25, 5), leaf("x", "b", 0.25, 100), leaf("y", "c", 0.5, 100)], ["domain", "source"], 100)
    assert got == [5, 45, 50]
    got = M.budget([leaf("x", "a", 0.25, 5), leaf("x", "b", 0.25, 20), leaf("y", "c", 0.5, 100)], ["domain", "source"], 100)
    assert got == [5, 20, 75]


def test_a_language_keeps_its_share_in_a_domain():
    leaf = lambda d, l, s, w, c: {"domain": d, "lang": l, "source": s, "weight": w, "cap": c}  # noqa: E731,E741
    leaves = [leaf("x", "de", "a", 0.2, 5), leaf("x", "de", "b", 0.2, 99), leaf("x", "en", "b", 0.2, 99), leaf("y", "en", "c", 0.4, 99)]
    assert M.budget(leaves, M.LEVELS, 100) == pytest.approx([5, 35, 20, 40])
    leaves[1]["cap"] = 21
    assert M.budget(leaves, M.LEVELS, 100) == pytest.approx([5, 21, 34, 40])


def test_a_source_is_short_only_if_its_leaves_are(spark):
    docs = [(1, "a", "en", 10), (2, "a", "de", 30), (3, "b", "en", 100), (4, "c", "de", 60)]
    told, _ = run(spark, docs, [(1, "a", 0.5, 2, 1.0), (1, "b", 0.3, 1, 1.0), (1, "c", 0.2, 1, 1.0)], {"a": "x", "b": "x", "c": "y"})
    assert {t["source"] for t in told if t["unmet"] > 0} == {"a"}
    assert sum(t["tokens"] for t in told) == pytest.approx(200) and all(t["tokens"] >= t["wanted"] - t["unmet"] - 1e-6 for t in told)


def test_shares_and_repeats(spark):
    docs = [(i, "big", "en" if i % 2 else None, 10) for i in range(1000)] + [(2000 + i, "small", "en", 10) for i in range(50)]
    told, rows = run(spark, docs, [(1, "big", 0.5, 1, 0.2), (1, "small", 0.5, 3, 0.2), (2, "big", 0.2, 1, 1.0), (2, "small", 0.8, 2, 1.0), (2, "none", 0.0, 2, 1.0)])
    assert abs(tokens(rows, 1, "big") - 1050) <= 20 and abs(tokens(rows, 1, "small") - 1050) <= 10
    assert {(t["mix_id"], t["source"]) for t in told if t["unmet"] > 0} == {(2, "small")}
    assert tokens(rows, 2, "small") == 1000 and max(r["repeats"] for r in rows if r["source"] == "small" and r["mix_id"] == 2) == 2
    assert tokens(rows, 2, "big") <= 10_000 and len({(r["mix_id"], r["doc_id"]) for r in rows}) == len(rows)
    again = run(spark, docs, [(1, "big", 0.5, 1, 0.2), (1, "small", 0.5, 3, 0.2)])[1]
    assert sorted(map(tuple, again)) == sorted(tuple(r) for r in rows if r["mix_id"] == 1)


def test_more_leaves_than_are_broadcast(spark, monkeypatch):
    docs = [(i, f"s{i % 5}", ["en", "de", None][i % 3], 1 + i % 7) for i in range(200)]
    mixes = [(1, f"s{i}", 0.2, 2, 1.0) for i in range(5)]
    few = sorted(map(tuple, run(spark, docs, mixes)[1]))
    monkeypatch.setattr(M, "MAX_LEAVES", 3)
    assert sorted(map(tuple, run(spark, docs, mixes)[1])) == few and few


def test_defined_cases(spark):
    docs = [(1, "a", "en", 0), (2, "a", "en", None), (3, None, "en", 5), (4, "b", None, 7)]
    told, rows = run(spark, docs, [(1, "a", 0.5, 2, 1.0), (1, "b", 0.5, None, 1.0), (2, "b", 1.0, 2, 1.5), (2, "b", 0.5, 1, 1.5), (3, None, 1.0, 1, 1.0), (None, "a", 1.0, 1, 1.0), (4, "b", None, 1, None), (5, "gone", 1.0, 1, 1.0)])
    assert {(t["mix_id"], t["source"]) for t in told if t["unmet"] > 0} == {(1, "a"), (1, "b")}
    assert {(r["mix_id"], r["doc_id"]): r["repeats"] for r in rows} == {(2, 4): 1} or {(r["mix_id"], r["doc_id"]): r["repeats"] for r in rows} == {(2, 4): 2}
    assert run(spark, [], [])[1] == []


@pytest.mark.skipif(not os.path.exists(M.VOCABULARY), reason="no tokenizer")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "日本語 <|endoftext|>"), (5, "a" * 20_000)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in M.token_counts(df, "text").collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] is None and got[4] > 4 and got[5] > 100
    assert M.token_counts(df.limit(0), "text").columns == ["doc_id", "n_tokens"]
