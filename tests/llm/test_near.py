import math
import random

import numpy as np

from tidemark.llm import near

SCHEMA = "id string, block string, text string, full string, a int"


def frame(spark, rows):
    return spark.createDataFrame([(i, b, t, "clash", 1) for i, b, t in rows], SCHEMA)


def pairs(spark, rows):
    return sorted(tuple(r) for r in near.similar_pairs(frame(spark, rows), "id", "block", "text").collect())


def brute(rows):
    sets = [(i, b, set((t or "").lower().split())) for i, b, t in rows if i is not None and b]
    out = set()
    for i, b, s in sets:
        for j, c, t in sets:
            if i < j and b == c and s and t and len(s & t) / math.sqrt(len(s) * len(t)) >= 0.8:
                out.add((i, j))
    return sorted(out)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.5:
            _, b, t = rng.choice(rows)
            t = t.split()
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rng.shuffle(t)
            rows.append((f"d{k:03d}", b, " ".join(t)))
        else:
            rows.append((f"d{k:03d}", f"b{rng.randint(0, 2)}", " ".join(rng.choices(words, k=rng.randint(15, 60)))))
    return rows


def test_same_as_brute_force(spark):
    rows = corpus(1)
    expected = brute(rows)
    got = pairs(spark, rows)
    assert set(got) <= set(expected)
    assert len(got) >= 0.99 * len(expected) > 50


def test_defined_cases(spark):
    long = " ".join(f"x{i}" for i in range(50_000))
    rows = [
        ("a", "s", "One two THREE"), ("b", "s", "three two one one"), ("b", "s", "three two one one"), ("c", "t", "one two three"), (None, "s", "one two three"),
        ("n", None, "one two three"), ("e", "", "one two three"), ("x", "s", ""), ("y", "s", None), ("z", "s", " \t\n"), ("l", "s", long), ("m", "s", long + " more"),
    ]
    assert pairs(spark, rows) == [("a", "b"), ("l", "m")]
    assert pairs(spark, []) == []


def test_an_id_with_several_texts_is_similar_by_any(spark):
    rows = [("a", "s", "one two three"), ("a", "s", "four five six"), ("b", "s", "six five four")]
    assert pairs(spark, rows) == [("a", "b")]


def test_groups(spark):
    rows = corpus(2)
    rows += [("k1", "b0", "alone in the world"), ("k2", "b9", "the world alone in")]
    got = {r["id"]: r for r in near.groups(frame(spark, rows), "id", "block", "text").collect()}
    assert len(got) == len(rows)
    head = {i: i for i, _, _ in rows}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    edges = [tuple(r) for r in near.similar_pairs(frame(spark, rows), "id", "block", "text").collect()]
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        head[y] = x
    assert {i: r["group_id"] for i, r in got.items()} == {i: find(i) for i in head}
    assert got["k1"]["n_links"] == 0


def test_a_hot_group_of_copies_is_one_class(spark):
    rows = [(f"c{i:04d}", "hot", "all the very same words here") for i in range(3000)] + [("d", "hot", "all the very same words here now")]
    classes, members = near.similar_classes(frame(spark, rows), "id", "block", "text")
    assert classes.count() == 1 and members.count() == 3001


def test_block_names(spark):
    df = spark.createDataFrame([("Check-Out_Gateway ",), ("--",), (None,)], "s string")
    assert [r[0] for r in df.select(near.block_of(df["s"])).collect()] == ["checkoutgateway", None, None]


def test_packing():
    keys, cls = np.array([1, 2**32 - 1], np.uint64), np.array([2**48 - 1, 2**63 + 5], np.uint64)
    a, b = near._unpack([near._pack(keys, cls).tobytes()])
    assert a.tolist() == [1, 2**32 - 1] and b.tolist() == [2**48 - 1, 5]


def test_the_count_filter_never_drops_a_similar_pair():
    rng = random.Random(4)
    words = near.Words()
    for _ in range(300):
        a = {f"w{rng.randint(0, 200)}" for _ in range(rng.randint(1, 60))}
        b = {w for w in a if rng.random() > 0.12} | {f"x{rng.randint(0, 200)}" for _ in range(rng.randint(0, 6))}
        flat, sizes = words([" ".join(a), " ".join(b)])
        x, y = near.counted_bytes(flat, sizes)
        (equal,), (many,) = near.tallied([x], [y])
        assert equal >= many - len(a ^ b)
        if b and len(a & b) / math.sqrt(len(a) * len(b)) >= 0.8:
            assert equal >= near.least_tally(sizes[:1], sizes[1:], many, 0.8)[0]


def test_every_size_has_a_minimum_above_zero():
    n = np.arange(1, 20_000)
    for ratio in (0.64, 0.7, 0.8, 0.9, 1.0):
        m = np.maximum(1, np.ceil(ratio * n)).astype(np.int64)
        many = np.minimum(near.positions(n), near.positions(m))
        assert (near.least_tally(n, m, many, 0.8) > 0).all()


def test_long_lists_meet_part_by_part():
    key = np.concatenate([np.zeros(5000, np.uint64), np.ones(3, np.uint64)])
    cls = np.random.default_rng(3).choice(2**40, len(key), replace=False).astype(np.uint64)
    key, cls = near._lists(np.concatenate([key, key[:9]]), np.concatenate([cls, cls[:9]]))
    assert len(key) == 5003
    parts = list(near._long(key, cls, 2048))
    assert len(parts) == 6 and max(len(x) for x, _ in parts) == 2048 * 8
    found = np.concatenate([np.stack(p, 1) for x, y in parts for p in near._crossed(x, y)])
    assert len(found) == len(np.unique(found, axis=0)) == 5000 * 4999 // 2 and (found[:, 0] < found[:, 1]).all()


def test_a_long_list_loses_no_pair(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(f"d{i:04d}", "hot", " ".join([*base, f"x{i}"])) for i in range(90)]
    pairs, _ = near.similar_classes(frame(spark, rows), "id", "block", "text", part=16)
    assert pairs.count() == len(rows) * (len(rows) - 1) // 2
