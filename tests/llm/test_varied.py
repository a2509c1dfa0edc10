import itertools
import random

from tidemark.llm import varied as R

HIT = "request_id bigint, id string, chunk_of string, score float, kind string, text string, service string, take string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, "clash") for r in rows], HIT)


def choose(spark, rows, takes):
    requests = spark.createDataFrame(takes, "request_id bigint, take int")
    out = {}
    for r in R.select(frame(spark, rows), requests).orderBy("request_id", "place").collect():
        out.setdefault(r["request_id"], []).append(r["id"])
    return out


def cost(scores, chosen, take, costs=R.Costs()):
    kinds, stories = {k for k, _ in scores}, {s for _, s in scores}
    target = -(-take // len(kinds))
    total = -sum(sum(scores[c][:n]) for c, n in chosen.items())
    for k in kinds:
        n = sum(v for c, v in chosen.items() if c[0] == k)
        total += (-costs.new_kind if n else 0) + costs.overuse_step * sum(max(0, i + 1 - target) for i in range(n))
    for s in stories:
        n = sum(v for c, v in chosen.items() if c[1] == s)
        total += sum(costs.reuse_first + costs.reuse_step * (i - 1) for i in range(1, n))
    return total


def test_the_flow_is_the_cheapest():
    rng = random.Random(3)
    for _ in range(30):
        combos = {(f"k{rng.randint(0, 2)}", rng.randint(0, 2)): sorted((round(rng.random(), 2) for _ in range(rng.randint(1, 3))), reverse=True) for _ in range(4)}
        take = rng.randint(1, 5)
        keys = sorted(combos)
        take = min(take, sum(len(v) for v in combos.values()))
        all_choices = (dict(zip(keys, c)) for c in itertools.product(*[range(len(combos[k]) + 1) for k in keys]) if sum(c) == take)
        best = min(cost(combos, c, take) for c in all_choices)
        got = R.quotas(combos, take)
        assert sum(got.values()) == take and abs(cost(combos, got, take) - best) < 1e-9
        free = R.quotas(combos, take, R.Costs(0.0, 0.0, 0.0, 0.0))
        assert abs(sum(sum(combos[c][:n]) for c, n in free.items()) - sum(sorted((x for v in combos.values() for x in v), reverse=True)[:take])) < 1e-9


def test_one_big_story_does_not_fill_the_choice(spark):
    big = [(1, f"b{i}", None, 0.9 - i / 1000, "logs", f"the same long story about one broken queue in zone {i}") for i in range(30)]
    rest = [(1, f"r{i}", None, 0.5, ["metrics", "git", "logs"][i % 3], f"unique{i} words{i} only{i} here{i}") for i in range(12)]
    got = choose(spark, big + rest, [(1, 10)])[1]
    assert len(got) == 10 and "b0" in got and sum(i.startswith("r") for i in got) >= 7


def test_defined_cases(spark):
    rows = [
        (1, "a", None, 0.5, "Logs ", "x y"), (1, "a", None, 0.5, "Logs ", "x y"), (1, "b", None, None, None, None), (1, "c", None, float("nan"), "", ""),
        (2, "p#c0", "p", 0.9, "git", "one"), (2, "p#c1", "p", 0.8, "git", "two"), (2, "q", None, 0.7, "git", "three"),
        (3, "z", None, 0.1, "git", "t"), (None, "y", None, 0.1, "git", "t"), (5, None, None, 0.1, "git", "t"), (4, "w", None, 0.1, "git", "t"),
    ]
    got = choose(spark, rows, [(1, 16), (2, 2), (3, 0), (4, None), (4, None), (None, 3)])
    assert got == {1: ["a", "b", "c"], 2: ["p#c0", "q"], 4: ["w"]}
    assert choose(spark, [], [(1, 3)]) == {}


def test_a_request_over_the_block_size(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 100)
    rows = [(1, f"h{i:04d}", None, (i % 97) / 97, f"k{i % 3}", f"w{i % 50}a w{i % 50}b w{i % 50}c") for i in range(1000)]
    got = choose(spark, rows, [(1, 10)])[1]
    assert len(got) == 10 and got == choose(spark, rows, [(1, 10)])[1]


def test_a_large_request_is_chosen_like_a_small_one(spark, monkeypatch):
    rng = random.Random(7)
    story = [(1, f"s{i:02}", None, 0.9 - i / 100, "git", f"one broken queue in zone {i}") for i in range(10)]
    rows = story + [(1, f"t{i:02}", None, 0.1 - i / 10000, "git", f"a{i} b{i} c{i}") for i in range(60)]
    # Stories linked by a chain of texts or a parent, all kinds, few and missing scores.
    for i in range(400):
        j = rng.randint(0, 60)
        text = rng.choice([f"x{j} y{j} x{j + 1} y{j + 1}", f"u{i} v{i}", None])
        rows.append((2, f"h{i:03}", rng.choice([None, None, None, f"p{i % 40}"]), rng.choice([None, rng.random(), rng.random(), rng.random()]), f"k{rng.randint(0, 3)}", text))
    takes = [(1, 10), (2, 12), (3, 500)]
    rows += [(3, i, p, s, k, t) for r, i, p, s, k, t in rows if r == 2]
    exact = choose(spark, rows, takes)
    assert sum(i.startswith("s") for i in exact[1]) == 3
    monkeypatch.setattr(R, "BLOCK", 50)
    assert choose(spark, rows, takes) == exact


def test_stories_of_many_words():
    rng = random.Random(2)
    texts = [" ".join(rng.sample([f"w{j}" for j in range(9000)], 5) + [f"s{i % 7}a", f"s{i % 7}b"] * 1) for i in range(40)] + [f"s{i % 7}a s{i % 7}b s{i % 7}c" for i in range(21)]
    head = R.stories(texts, [None] * len(texts))
    sets = [set(t.split()) for t in texts]
    for i in range(40, 61):
        assert head[i] == min(j for j in range(40, 61) if (j - 40) % 7 == (i - 40) % 7)
    assert all(head[i] == i for i in range(40) if not any(4 * len(sets[i] & s) ** 2 >= len(sets[i]) * len(s) for j, s in enumerate(sets) if j != i))
    whole = R.WORDS
    try:
        R.WORDS = 3
        assert R.stories(texts, [None] * len(texts)) == head
    finally:
        R.WORDS = whole


def test_quality(spark):
    rows = [(1, f"b{i}", None, 0.9 - i / 100, "logs", "one story told again and again") for i in range(8)] + [(1, f"r{i}", None, 0.5, "git", f"u{i} v{i}") for i in range(4)]
    got = R.quality(frame(spark, rows), spark.createDataFrame([(1, 4)], "request_id bigint, take int")).collect()
    assert len(got) == 1
    assert (got[0]["n_chosen"], got[0]["top_n_stories"], got[0]["top_n_kinds"], got[0]["top_mean_score"]) == (4, 1, 1, 0.885) and got[0]["n_stories"] > 1 and got[0]["n_kinds"] == 2
