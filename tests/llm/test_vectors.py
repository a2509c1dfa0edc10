import numpy as np

from tidemark.llm import vectors as V

SCHEMA = "id string, vector array<float>, cls int, q int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)


def brute(rows, k=5):
    ids = sorted(i for i, _ in rows)
    x = np.array([dict(rows)[i] for i in ids], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {i: [ids[j] for j in np.argsort(-s[n], kind="stable")[:k]] for n, i in enumerate(ids)}


def clustered(n=1500, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(40, dim))
    x = centre[rng.integers(0, 40, n)] + rng.normal(size=(n, dim)) * 0.3
    return [(f"p{i:05d}", (x[i] * rng.uniform(0.5, 2)).tolist()) for i in range(n)]


def test_recall_against_brute_force(spark):
    rows = clustered()
    expected = brute(rows)
    got = {}
    for r in V.neighbours(frame(spark, rows), "id", "vector", 5).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    assert set(got) == set(expected)
    recall = np.mean([len(got[i] & set(expected[i])) / 5 for i in expected])
    assert recall >= 0.9
    asked = frame(spark, rows[:50])
    out = V.neighbours(frame(spark, rows), "id", "vector", 5, queries=asked).collect()
    assert {r["id"] for r in out} == {i for i, _ in rows[:50]}
    assert np.mean([r["neighbour"] in expected[r["id"]] for r in out]) >= 0.9


def test_unusable_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.1]), ("n", None), ("e", []), ("z", [0.0, 0.0]), ("w", [1.0, 0.0, 0.0]), ("h", [None, 1.0]), ("f", [float("nan"), 1.0]), ("i", [float("inf"), 1.0]), (None, [1.0, 0.0])]
    got = V.neighbours(frame(spark, rows), "id", "vector", 5).collect()
    assert sorted((r["id"], r["neighbour"]) for r in got) == [("a", "b"), ("b", "a")]
    assert V.neighbours(frame(spark, []), "id", "vector", 5).count() == 0
    assert V.neighbours(frame(spark, [("z", [0.0])]), "id", "vector", 5).count() == 0


def test_copies_and_ties_go_to_the_smaller_id(spark):
    rows = [(f"c{i:03d}", [3.0, 4.0]) for i in range(200)] + [("x", [0.0, 1.0]), ("c000", [3.0, 4.0])]
    got = {}
    for r in V.neighbours(frame(spark, rows), "id", "vector", 5).orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    first = [f"c{i:03d}" for i in range(6)]
    assert got["c150"] == first[:5] and got["c002"] == [c for c in first if c != "c002"] and got["x"] == first[:5]


def test_least_score(spark):
    rows = clustered(400)
    got = V.neighbours(frame(spark, rows), "id", "vector", 5, min_score=0.9).collect()
    assert got and all(r["score"] >= 0.9 for r in got)


def test_long_lists_are_divided(spark, monkeypatch):
    monkeypatch.setattr(V, "MAX_LIST", 40)
    monkeypatch.setattr(V, "LIST_SIZE", 400)
    rows = clustered(800)
    index = V.fit(np.array([np.array(v) / np.linalg.norm(v) for _, v in rows]), 800)
    assert index.parts.max() > 1
    expected, got = brute(rows), {}
    for r in V.neighbours(frame(spark, rows), "id", "vector", 5).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    assert np.mean([len(got[i] & set(expected[i])) / 5 for i in expected]) >= 0.9


def test_small_lists_give_queries_all_their_members(spark, monkeypatch):
    monkeypatch.setattr(V, "LIST_SIZE", 4)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 8))
    point = np.repeat(centre, 4, 0) + rng.normal(size=(24, 8)) * 0.05
    query = np.repeat(centre, 2, 0) + rng.normal(size=(12, 8)) * 0.05
    rows, asked = [(f"p{i:02}", x.tolist()) for i, x in enumerate(point)], [(f"q{i:02}", x.tolist()) for i, x in enumerate(query)]
    cosine = (query / np.linalg.norm(query, axis=1, keepdims=True)) @ (point / np.linalg.norm(point, axis=1, keepdims=True)).T
    got = {}
    for r in V.neighbours(frame(spark, rows), "id", "vector", 5, queries=frame(spark, asked), probe_ratio=1e9).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    assert got == {f"q{i:02}": {f"p{j:02}" for j in np.argsort(-c)[:5]} for i, c in enumerate(cosine)}
