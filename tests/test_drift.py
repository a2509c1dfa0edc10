import itertools
import json
import random

from tidemark.operators import drift
from tidemark.operators.drift import SEP, _assign, changes, edit_script, unify

ROW = "w string, f int, id string, p string, change string"


def found(spark, rows, depth=1):
    df = spark.createDataFrame([(w, f, i, p if p is None or isinstance(p, str) else json.dumps(p), "extra") for w, f, i, p in rows], ROW)
    return sorted(tuple(r) for r in changes(df, "w", "f", "id", "p", depth).select("w", "f", "change", "field", "new_field").collect())


def test_each_kind_of_change(spark):
    rows = [
        ("a", 1, "x", {"Title": "t", "n": 1, "gone": 1}),
        ("a", 1, "y", {"Title": "u", "n": 2}),
        ("a", 2, "x", {"title": "t", "n": "1", "new": None}),
        ("a", 2, "z", {"title": "v", "n": "9"}),
    ]
    assert found(spark, rows) == [("a", 2, "added", "new", ""), ("a", 2, "removed", "gone", ""), ("a", 2, "renamed", "Title", "title"), ("a", 2, "retyped", "n", "")]


def test_a_rename_needs_equal_values_everywhere_and_one_at_least(spark):
    base = [("a", 1, "x", {"A": 1}), ("a", 1, "y", {"A": 2})]
    assert ("a", 2, "removed", "A", "") in found(spark, [*base, ("a", 2, "x", {"B": 1}), ("a", 2, "y", {"B": 3})])
    assert ("a", 2, "removed", "A", "") in found(spark, [*base, ("a", 2, "z", {"B": 1})])
    assert found(spark, [("a", 1, "x", {"A": None}), ("a", 2, "x", {"B": None})]) == [("a", 2, "added", "B", ""), ("a", 2, "removed", "A", "")]
    # Absent and null are equal.
    assert found(spark, [("a", 1, "x", {"A": 1}), ("a", 1, "y", {"A": None}), ("a", 2, "x", {"B": 1}), ("a", 2, "y", {})]) == [("a", 2, "renamed", "A", "B")]


def test_unreadable_rows_gaps_and_other_writers_are_left_out(spark):
    rows = [("a", 1, "x", {"A": 1}), ("a", 1, "y", None), ("a", 1, "z", '{"Z": 1'), ("a", 1, "q", "[1]"), ("a", 1, "n", '{"N": NaN}'), ("a", 2, "x", {"A": 1}), ("a", 4, "x", {"C": 1}), ("b", 2, "x", {"D": 1})]
    assert found(spark, rows) == []


def test_nulls_repeats_and_an_empty_table(spark):
    rows = [("a", 1, "x", {"A": 1}), ("a", 1, "x", {"A": 1}), ("a", 2, "x", {"B": 1}), ("a", 2, None, {"B": 7}), (None, 2, "x", {"B": 1}), ("a", None, "x", {"B": 1})]
    assert found(spark, rows) == [("a", 2, "renamed", "A", "B")]
    assert found(spark, []) == []


def test_nested_fields_and_moves(spark):
    rows = [("a", 1, "x", {"m": {"k": "v", "o": 1}, "t": 1}), ("a", 2, "x", {"m": {"o": 1}, "t": 1, "k": "v"})]
    assert found(spark, rows, 3) == [("a", 2, "moved", "m.k", "k")]
    assert found(spark, [("a", 1, "x", {"m": {"k": "v"}}), ("a", 2, "x", {"m": {"K": "v"}})], 3) == [("a", 2, "renamed", "m.k", "m.K")]


def test_the_script_has_the_least_cost():
    # b could take either name, a only one: both renames must be found.
    old, new = {"a": ["string"], "b": ["string"]}, {"x": ["string"], "y": ["string"]}
    script = edit_script(old, new, {("a", "x"), ("b", "x"), ("b", "y")})
    assert script == [("renamed", "a", "x"), ("renamed", "b", "y")]
    # A gone object counts once, not with all its fields.
    assert edit_script({"m": ["object"], f"m{SEP}k": ["string"]}, {}, set()) == [("removed", "m", "")]


def test_a_renamed_object_is_compared_inside():
    tree = lambda *paths: {p.replace(".", SEP): ["object" if any(q.startswith(p + ".") for q in paths) else "string"] for p in paths}
    same = {(f"meta{SEP}a", f"Meta{SEP}a"), (f"meta{SEP}b", f"Meta{SEP}b")}
    assert edit_script(tree("meta", "meta.a", "meta.b"), tree("Meta", "Meta.a", "Meta.b", "Meta.c"), same) == [("added", f"Meta{SEP}c", ""), ("renamed", "meta", "Meta")]
    # Without a value that was kept it is another object.
    assert edit_script(tree("meta", "meta.a"), tree("Meta", "Meta.a"), set()) == [("added", "Meta", ""), ("removed", "meta", "")]
    # Keeping the fields inside is worth more than the one equal value of another object.
    old, new = tree("m", "m.a", "m.b", "m.c"), tree("n", "n.a", "n.b", "n.c", "o", "o.a")
    same = {(f"m{SEP}a", f"o{SEP}a"), (f"m{SEP}a", f"n{SEP}a")}
    assert edit_script(old, new, same) == [("added", "o", ""), ("renamed", "m", "n")]


def test_assignment_is_the_best_of_all():
    rng = random.Random(3)
    for _ in range(200):
        rows, cols = rng.randint(1, 4), rng.randint(1, 4)
        worth = {(f"r{i}", f"c{j}"): rng.randint(1, 9) for i in range(rows) for j in range(cols) if rng.random() < 0.7}
        pairs = _assign(worth)
        best = max(
            sum(worth.get((f"r{i}", f"c{j}"), 0) for i, j in (zip(range(rows), p) if rows <= cols else zip(p, range(cols)))) for p in itertools.permutations(range(max(rows, cols)), min(rows, cols))
        )
        assert sum(worth[p] for p in pairs.items()) == best and len(set(pairs.values())) == len(pairs)


def test_any_depth_and_items_of_arrays(spark):
    deep = lambda v: {"a": {"b": {"c": {"d": {"e": {"f": v}}}}}}
    assert found(spark, [("a", 1, "x", deep(1)), ("a", 2, "x", deep("1"))], None) == [("a", 2, "retyped", "a.b.c.d.e.f", "")]
    rows = [("a", 1, "x", {"l": [{"k": 1, "o": 2}, {"k": 3}]}), ("a", 2, "x", {"l": [{"z": 1, "o": 2}, {"z": 3}]})]
    assert found(spark, rows, None) == [("a", 2, "renamed", "l.[].k", "l.[].z")]
    long = {"k": 0}
    for _ in range(400):
        long = {"n": long}
    assert len(found(spark, [("a", 1, "x", {"A": 1}), ("a", 2, "x", {"A": 1, "deep": long})], None)) == 1


def table(spark, rows):
    df = spark.createDataFrame(rows, "w string, f int, id string, p string")
    return unify(df, "w", "f", "id", "p")


def test_one_table(spark):
    rows = [
        ("a", 1, "x", '{"Title": "t", "meta": {"k": [1]}, "n": 1, "ok": true}'), ("a", 2, "x", '{"heading": "t", "n": 12345678901234567}'), ("a", 2, "y", "broken"), ("a", 3, "x", '{"heading": "t", "Title": "new"}'),
        ("b", 1, "z", '{"Title": "one", "title": "two", "id": 5, "heading": 7}'), ("b", None, "z", '{"title": "q"}'),
    ]
    out = table(spark, rows)
    assert out.columns == ["w", "f", "id", "p", "heading", "id_", "meta", "n", "ok", "title", "rest"]
    assert dict(out.dtypes)["n"] == "double" and dict(out.dtypes)["ok"] == "boolean" and dict(out.dtypes)["heading"] == "string"
    got = {(r["w"], r["f"], r["id"]): r for r in out.collect()}
    assert (got["a", 1, "x"]["heading"], got["a", 1, "x"]["title"], got["a", 1, "x"]["meta"], got["a", 1, "x"]["ok"]) == ("t", None, '{"k":[1]}', True)
    assert (got["a", 2, "x"]["n"], got["a", 2, "x"]["rest"]) == (None, {"n": "12345678901234567"})
    assert (got["a", 3, "x"]["heading"], got["a", 3, "x"]["title"]) == ("t", "new")
    # A rename of another writer says nothing here; one of two alike names finds no column.
    b = got["b", 1, "z"]
    assert {b["title"], *b["rest"].values()} == {"one", "two"} and b["heading"] == "7" and b["id_"] == 5.0
    assert got["b", None, "z"]["title"] == "q" and got["a", 2, "y"]["title"] is None


def test_no_value_is_lost(spark):
    rng = random.Random(9)
    rows, sent = [], 0
    for w in ("a", "b", "c"):
        names = ["A", "b", "c d", "a", "E.f"]
        for f in range(1, 6):
            for i in range(4):
                value = {n: f"{n}{w}{i}" for n in names if rng.random() < 0.9}
                sent += len(value)
                rows.append((w, f, f"r{i}", json.dumps(value)))
            names[rng.randrange(5)] = rng.choice(["A", "B", "a", "x", "Y"]) + str(rng.randint(0, 1))
            names = list(dict.fromkeys(names)) + ["fill"] * (5 - len(dict.fromkeys(names)))
    out = table(spark, rows)
    fields = out.columns[4:-1]
    assert sum(sum(r[c] is not None for c in fields) + len(r["rest"] or {}) for r in out.collect()) == sent


def test_a_name_that_comes_again_is_another_field(spark):
    rows = [("a", 1, "x", '{"A": "1", "k": 0}'), ("a", 2, "x", '{"k": 0}'), ("a", 3, "x", '{"A": "2", "k": 0}'), ("a", 4, "x", '{"D": "2", "k": 0}')]
    assert [(r["a"], r["d"]) for r in table(spark, rows).orderBy("f").collect()] == [("1", None), (None, None), (None, "2"), (None, "2")]


def test_more_files_than_are_broadcast(spark, monkeypatch):
    rows = [("a", f, "x", {f"n{f}": "v", "k": 1}) for f in range(1, 5)]
    few = found(spark, rows)
    monkeypatch.setattr(drift, "MAX_FILES", 1)
    assert found(spark, rows) == few and len(few) == 3
    assert [r["n4"] for r in table(spark, [(w, f, i, json.dumps(p)) for w, f, i, p in rows]).collect()] == ["v"] * 4


def test_an_empty_table(spark):
    assert table(spark, []).columns == ["w", "f", "id", "p", "rest"] and table(spark, []).count() == 0
