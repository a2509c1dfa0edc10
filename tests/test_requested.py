import json
import random
from datetime import datetime

from tidemark.operators.requested import counts

ASKED = "request_id bigint, service string, env string, from_utc string, to_utc string, client_zone string, filters array<string>"
DOCS = "id string, service string, environment string, timestamp string, source_zone string, metadata string"


def instant(text):
    return None if text is None or not text.strip() else datetime.fromisoformat(text).timestamp()


def brute(asked, docs):
    out = {}
    for request, service, env, start, end, _, filters in asked:
        if "soon" in (start, end):
            out[request] = None
            continue
        a, b = instant(start), instant(end)
        if a is not None and b is not None and a > b:
            a, b = b, a
        found = set()
        for id_, s, e, at, _, metadata in docs:
            t = instant(at)
            tags = {f"service:{s}", f"env:{e}", *(json.loads(metadata).get("tags", []) if metadata else [])}
            ok = (not service or s == service) and (not env or e == env) and all(f in tags for f in filters or [] if f)
            if id_ and ok and (a is None or (t is not None and t >= a)) and (b is None or (t is not None and t < b)):
                found.add(id_)
        out[request] = len(found)
    return out


def test_counts_are_those_of_brute_force(spark):
    rng = random.Random(5)
    at = lambda: f"2025-0{rng.randint(1, 3)}-{rng.randint(1, 28):02}T0{rng.randint(0, 3)}:{rng.choice(['00', '30'])}:00Z"
    docs = []
    for i in range(300):
        s, e = rng.choice(["a", "b", "c", ""]), rng.choice(["prod", "dev", ""])
        m = rng.choice([None, "{}", '{"tags": ["team:x"]}', '{"tags": ["team:x", "env:prod"]}'])
        docs += [(f"d{i}", s, e, rng.choice([None, at(), at(), at()]), None, m) for _ in range(rng.choice([1, 1, 1, 2, 3]))]
    # One id whose rows differ in everything, instants centuries apart, and no id.
    docs += [("mixed", "a", "prod", "2025-02-01T00:00:00Z", None, None), ("mixed", "b", "dev", "2025-02-03T00:00:00Z", None, '{"tags": ["team:x"]}')]
    docs += [("far", "a", "prod", t, None, None) for t in ("1200-01-01T00:00:00Z", "2025-02-01T00:00:00Z", "2900-01-01T00:00:00Z")] + [(None, "a", "prod", at(), None, None)]
    asked = []
    for i in range(400):
        start, end = (rng.choice([None, at(), at(), at()]) for _ in range(2))
        asked.append((i, rng.choice([None, "", "a", "b", "nowhere"]), rng.choice([None, "prod", "dev"]), start, end, None, rng.choice([None, [], ["env:prod"], ["team:x"], ["team:x", "service:a"], ["team:none"]])))
    asked += [(1000, "a", None, "soon", None, None, None), (1001, None, None, None, "soon", None, []), (1002, None, None, " ", None, None, None), (1003, None, "", None, "2025-02-01T00:00:00Z", None, None)]
    got = {r["request_id"]: r["n_documents"] for r in counts(spark.createDataFrame(asked, ASKED), spark.createDataFrame(docs, DOCS)).collect()}
    expected = brute(asked, docs)
    assert got == expected
    assert sum(1 for n in expected.values() if n) > 100 and got[1002] >= 300 and got[1000] is None
