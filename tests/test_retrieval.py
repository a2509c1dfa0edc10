import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.config import Settings, TopK
from tidemark.functions import exprs as E
from tidemark.operators import context, rerank, search, store
from tidemark.operators.answer import ask, filtered
from tidemark.operators.chunking import chunk
from tidemark.operators.embed import hash_embedding, with_provider
from tidemark.operators.planner import decode_plan, plan, plan_with_model
from tidemark.providers import Extractive
from tidemark.sources import observability as obs

NOW = 1_767_225_600


def value(spark, column, **cells):
    names = list(cells)
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double'}" for n, v in cells.items())).select(column.alias("x")).first()["x"] if names else spark.range(1).select(column.alias("x")).first()["x"]


CHUNKS = [("", 100, 20, []), ("Some text", 0, 20, []), ("Short text", 100, 20, ["Short text"]), ("0123456789", 5, 0, ["01234", "56789"]), ("0123456789", 5, 2, ["01234", "34567", "6789"]), ("0123456789", 5, 5, ["01234", "56789"]), ("0123456789", 5, 10, ["01234", "56789"]), (None, 5, 1, [])]


@pytest.mark.parametrize(("text", "most", "overlap", "expected"), CHUNKS)
def test_chunks(spark, text, most, overlap, expected):
    df = spark.createDataFrame([("d", text, 1)], "id string, text string, other int")
    rows = chunk(df, most, overlap).orderBy("chunk_index").collect()
    assert [r["text"] for r in rows] == expected
    assert [r["id"] for r in rows] == [f"d#c{i}" for i in range(len(expected))]
    assert all(r["chunk_of"] == "d" and r["other"] == 1 for r in rows)


def test_chunks_count_characters(spark):
    text = "日本語テキスト😀😀あいうえお"
    rows = chunk(spark.createDataFrame([("d", text)], "id string, text string"), 8, 2).orderBy("chunk_index").collect()
    assert all(len(r["text"]) <= 8 for r in rows)
    assert rows[0]["text"] + "".join(r["text"][2:] for r in rows[1:]) == text


@pytest.mark.parametrize(
    ("question", "config", "k"),
    [("simple query", TopK(), 16), ("why did the service fail?", TopK(), 22), ("what is the ROOT CAUSE?", TopK(), 22), ("RCA analysis needed", TopK(), 22), ("errors yesterday", TopK(), 18), ("logs from 10:00 to 11:00", TopK(), 18), ("show me the incident", TopK(), 18), ("sev1 issues", TopK(), 18), ("why the incident yesterday", TopK(), 26), ("why", TopK(16, 20), 20), ("simple", TopK(10), 10), ("x", TopK(fixed=25), 25), ("x", TopK(fixed=100), 64), ("x", TopK(fixed=0), 1)],
)
def test_dynamic_topk(spark, question, config, k):
    assert value(spark, E.dynamic_topk(F.col("q"), config), q=question) == k


def test_scalars(spark):
    assert value(spark, E.percent_encoded(F.col("t")), t="custom.metric:rate *~x") == "custom.metric%3Arate%20%2A~x"
    assert value(spark, E.shortest_number(F.col("n")), n=99.0) == "99"
    assert value(spark, E.shortest_number(F.col("n")), n=99.9) == "99.9"
    tags = F.array(F.lit("env:prod"), F.lit("service:a"), F.lit("service:b"))
    assert value(spark, E.tag_value(tags, "service")) == "a"
    assert value(spark, E.tag_value(tags, "team")) == ""
    assert value(spark, E.stable_id(F.lit("a"), F.lit("b"))) != value(spark, E.stable_id(F.lit("b"), F.lit("a")))
    assert len(value(spark, E.stable_id(F.lit("a")))) == 32
    assert value(spark, E.kind_code(F.col("k")), k=" SLO ") == "sLO"
    assert value(spark, E.kind_code(F.col("k")), k="other") is None
    assert value(spark, E.json_text(F.col("j"), "$.a", "d"), j='{"a": 5}') == "d"
    assert value(spark, E.json_text(F.col("j"), "$.a", "d"), j="broken") == "d"
    assert value(spark, E.json_text(F.col("j"), "$.a", "d"), j=None) == "d"
    assert value(spark, E.json_strings(F.col("j"), "$.t"), j='{"t": ["a", 1, null, "b"]}') == ["a", "b"]


@pytest.mark.parametrize(("n", "cut"), [(1499, False), (1500, False), (1501, True)])
def test_excerpt(spark, n, cut):
    got = value(spark, E.excerpt(F.col("t")), t="a" * n)
    assert got == ("a" * 1500 + E.CUT_MARK if cut else "a" * n)


def test_excerpt_never_splits_a_character(spark):
    for pad in range(4):
        text = "x" * pad + "😀" * 500
        got = value(spark, E.excerpt(F.col("t")), t=text)
        body = got.removesuffix(E.CUT_MARK)
        assert text.startswith(body) and 1497 <= len(body.encode()) <= 1500


def test_rfc3339_is_strict(spark):
    for text, ok in [("2025-01-01T00:00:00Z", True), ("2025-01-01t00:00:00.5+01:00", True), ("2025", False), ("2025-01-01", False), ("2025-01-01T00:00:00", False), ("2025-13-01T00:00:00Z", False), (None, False)]:
        assert (value(spark, E.rfc3339_seconds(F.col("t")), t=text) is not None) == ok, text


def candidates(spark, rows):
    schema = "request_id bigint, id string, chunk_of string, score float, kind string, text string, seconds bigint"
    df = spark.createDataFrame([(1, i, p, s, k, t, 1_735_689_600) for i, p, s, k, t in rows], schema)
    return rerank.top_candidates(df, 64)


def chosen(spark, rows, take, **options):
    takes = spark.createDataFrame([(1, take)], "request_id bigint, take int")
    out = rerank.rerank(candidates(spark, rows), takes, NOW, **options).orderBy("place").collect()
    return [r["id"] for r in out], [round(r["score"], 4) for r in out]


def test_mmr_orders(spark):
    four = [(str(i + 1), None, s, "logs", f"{w} unique text") for i, (s, w) in enumerate([(0.9, "first"), (0.8, "second"), (0.7, "third"), (0.6, "fourth")])]
    assert chosen(spark, four, 2) == (["1", "2"], [0.441, 0.392])
    pair = [("1", None, 0.9, "logs", "the same text here"), ("2", None, 0.85, "logs", "the same text here"), ("3", None, 0.8, "logs", "another thing entirely")]
    assert chosen(spark, pair, 2)[0] == ["1", "3"]
    monitors = [(str(i + 1), None, s, "monitor", w) for i, (s, w) in enumerate([(0.9, "alpha"), (0.8, "beta"), (0.7, "gamma"), (0.6, "delta")])]
    assert chosen(spark, monitors, 3) == (["1", "2", "3"], [0.4725, 0.42, 0.3675])


def test_mmr_parents_and_passthrough(spark):
    rows = [("a#c0", "a", 0.9, "monitor", "x y"), ("a#c1", "a", 0.95, "monitor", "x z"), ("b", None, 0.5, "monitor", "q")]
    assert chosen(spark, rows, 2)[0] == ["a#c1", "b"]
    assert chosen(spark, rows, 3) == (["a#c1", "a#c0", "b"], [0.95, 0.9, 0.5])
    assert chosen(spark, rows, 3, always=True)[0] == ["a#c1", "b"]
    disjoint = [(f"{i:02d}", None, 1 - i / 100, "git", f"w{i}") for i in range(30)]
    assert chosen(spark, disjoint, 10)[0] == [f"{i:02d}" for i in range(10)]


def test_mmr_nulls(spark):
    rows = [("a", None, None, None, None), ("b", None, 0.5, "logs", None), ("c", None, 0.4, "logs", "")]
    assert chosen(spark, rows, 2)[0] == ["b", "c"]


def test_context(spark):
    schema = "request_id bigint, place int, id string, title string, kind string, timestamp string, service string, environment string, source_uri string, score double, metadata string, text string"
    rows = [(1, 2, "b", "B", "logs", None, "", "", "u2", 0.5, '{"other": 1}', "two"), (1, 1, "a", "A", "sLO", "2025-01-01T00:00:00Z", "svc", "prod", "u1", 0.25, '{"status": "error", "severity": "SEV-1", "tags": []}', "one"), (2, 1, "c", None, None, None, None, None, None, None, "broken", None)]
    got = {r["request_id"]: r["context"] for r in context.render(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == (
        '[DOC #1] A (Slo)\nTime: 2025-01-01T00:00:00Z\nService: svc | Env: prod\nSource: u1\nScore: 0.250\nseverity: "SEV-1"\nstatus: "error"\nExcerpt:\none\n\n'
        "[DOC #2] B (Logs)\nSource: u2\nScore: 0.500\nExcerpt:\ntwo\n\n"
    )
    assert got[2] == "[DOC #1]  (Unknown)\nSource: \nExcerpt:\n\n\n"


def raw(spark, value):
    return spark.createDataFrame([(json.dumps(value),), (None,), ("broken",)], "payload string")


def test_monitor_source(spark):
    r = obs.monitors(raw(spark, [{"id": 12345, "name": "Test", "message": "M", "query": "Q", "type": "T", "tags": ["env:prod", "service:api", 7]}, {"id": "x"}])).orderBy("id").collect()
    assert [x["id"] for x in r] == ["monitor_0", "monitor_12345"]
    assert (r[1]["service"], r[1]["environment"], r[1]["text"]) == ("api", "prod", "Test\n\nQuery: Q\n\nMessage: M")
    assert json.loads(r[1]["metadata"]) == {"monitor_type": "T", "query": "Q", "tags": ["env:prod", "service:api"]}
    assert r[0]["title"] == "" and r[0]["timestamp"] is None


def test_other_sources(spark):
    log = obs.logs(raw(spark, {"data": [{"id": "log1", "attributes": {"message": "m", "service": "ignored", "status": "error", "tags": ["env:prod"]}}]})).first()
    assert (log["id"], log["service"], log["environment"], log["title"], log["timestamp"]) == ("log_log1", "", "prod", "Log:  - error", None)
    inc = obs.incidents(raw(spark, {"data": [{"id": "inc-1", "attributes": {"title": "T", "created": "2025-01-01T10:00:00Z", "fields": {"service": "a"}}}]})).first()
    assert (inc["text"], inc["service"], inc["environment"]) == ("T\n\nSeverity: UNKNOWN\n\nCustomer Impact: ", "a", "")
    dash = obs.dashboards(raw(spark, {"dashboards": [{"id": "d", "title": "T", "description": ""}]})).first()
    assert dash["text"] == "T"
    met = obs.metrics(raw(spark, {"metrics": ["a.b:c", "solo"]}), "2025-01-01T00:00:00Z").orderBy("id").collect()
    assert [(m["id"], m["service"], m["source_uri"].split("=")[1]) for m in met] == [("metric_a_b:c", "a", "a.b%3Ac"), ("metric_solo", "solo", "solo")]
    slo = obs.slos(raw(spark, {"data": [{"id": "s", "name": "N", "type": "t", "thresholds": [{"target": 0.5}]}, {"id": "z", "thresholds": []}]})).orderBy("id").collect()
    assert slo[0]["text"] == "N\n\nType: t\nTarget: 50%" and slo[1]["text"].endswith("Target: 0%")
    assert obs.logs(raw(spark, {"errors": []})).count() == 0


def test_landed_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"metrics": ["x.y"]}))
    assert obs.metrics(obs.read_landed(spark, str(tmp_path)), "now").count() == 1


def test_latest_is_idempotent(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None), (None, 3, "z")], "id string, v int, t string")
    once = store.latest(df, "id", "v")
    assert sorted(tuple(r) for r in once.collect()) == [("a", 2, "y"), ("b", 1, None)]
    assert sorted(map(tuple, store.latest(once.union(once), "id", "v").collect())) == sorted(map(tuple, once.collect()))


def test_versioned_store(spark, tmp_path):
    s = store.VersionedStore(spark, str(tmp_path / "s"), by="id", buckets=8)
    assert s.read() is None
    s.upsert(spark.createDataFrame([(f"k{i}", 1) for i in range(40)], "id string, v int"), "id", "v")
    before = json.loads((tmp_path / "s" / "manifests" / s.versions()[0]).read_text())["data"]
    s.upsert(spark.createDataFrame([("k1", 2), ("k2", 0)], "id string, v int"), "id", "v")
    assert sorted(map(tuple, s.read().collect())) == sorted([(f"k{i}", 1) for i in range(40) if i != 1] + [("k1", 2)])
    after = json.loads((tmp_path / "s" / "manifests" / s.versions()[1]).read_text())["data"]
    assert len(s.versions()) == 2 and 1 <= sum(after[b] != before[b] for b in before) <= 2
    # Of two writers with the same number one fails.
    with pytest.raises(Exception, match="(?i)exist"):
        store.put(spark, str(tmp_path / "s" / "manifests" / s.versions()[1]), "{}", over=False)
    store.put(spark, str(tmp_path / "x"), "1", over=True)
    store.put(spark, str(tmp_path / "x"), "2", over=True)
    assert (tmp_path / "x").read_text() == "2"


def test_batches(spark):
    df = spark.range(0, 1000, 1, 3)
    sizes = [r["n"] for r in store.batches(df, 64).collect()]
    assert sum(sizes) == 1000 and max(sizes) == 64


def test_batches_are_sent(spark, tmp_path):
    def send(rows):
        (tmp_path / f"{rows[0]['id']}-{len(rows)}").write_text(json.dumps(rows))

    df = spark.range(0, 150, 1, 1).select("id", F.lit("x").alias("text"))
    assert sorted(r["n"] for r in store.batches(df, 64, send).collect()) == [22, 64, 64]
    told = [r for p in tmp_path.iterdir() for r in json.loads(p.read_text())]
    assert sorted(r["id"] for r in told) == list(range(150)) and told[0]["text"] == "x"


def test_window(spark):
    for cursor, start in [(" 2025-01-01T00:00:00Z\n", 1735689600), ("bad", NOW - 5400), (None, NOW - 5400)]:
        w = value(spark, store.window(F.col("c"), F.lit(NOW)), c=cursor)
        assert (w["from_s"], w["to_s"]) == (start, NOW)


def test_payload_round_trip(spark):
    df = spark.createDataFrame([("T", "x", None, "logs", None, "s", "e", '{"a": 1}', "i"), (None,) * 9], "title string, text string, source_uri string, kind string, timestamp string, service string, environment string, metadata string, id string")
    rows = [json.loads(r[0]) for r in df.select(store.payload()).collect()]
    assert rows[0] == {"Title": "T", "Text": "x", "SourceUri": None, "Kind": "logs", "Timestamp": None, "Service": "s", "Environment": "e", "Metadata": {"a": 1}, "id": "i"}
    assert rows[1]["Metadata"] == {}


def test_knn(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, []), (7, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<float>")
    got = search.knn(df, df, "id", "v", 1, exclude_self=True).orderBy("query_id").collect()
    assert [(r["query_id"], r["neighbour_id"], round(r["score"], 6)) for r in got] == [(1, 2, 1.0), (2, 1, 1.0), (3, 1, 0.0)]
    top = search.top_for_vector(df.where("id <= 5 and size(v) = 2"), "id", "v", [1.0, 0.0], 2).collect()
    assert [r["id"] for r in top] == [1, 2]
    assert search.knn(df.limit(0), df, "id", "v", 3).count() == 0


def test_embedding(spark):
    df = spark.createDataFrame([("the same words",), ("words the same same",), ("",), (None,)], "t string").select(hash_embedding(F.col("t")).alias("v"))
    v = [r["v"] for r in df.collect()]
    assert v[0] == v[1] and abs(sum(x * x for x in v[0]) - 1) < 1e-6 and not any(v[2]) and not any(v[3])
    own = with_provider(spark.createDataFrame([("ab",), (None,)], "t string"), "t", lambda texts: [[float(len(t))] for t in texts])
    assert [r["vector"] for r in own.collect()] == [[2.0], [0.0]]


def test_plan_and_filters(spark):
    df = spark.createDataFrame([("Why is payment-api failing in prod?", None), (None, None), ("errors", "dev")], "question string, env string")
    rows = [r["plan"] for r in plan(df, "question", "env").collect()]
    assert (rows[0]["intent"], rows[0]["service"], rows[0]["environment"], rows[0]["filters"]) == ("rootCause", "payment-api", "prod", ["service:payment-api", "env:prod"])
    assert rows[1]["missingFields"] == ["service", "environment"] and len(rows[1]["clarifyingQuestions"]) == 2
    assert rows[2]["environment"] == "dev"

    def broken(_):
        raise RuntimeError

    assert value(spark, decode_plan(F.lit(plan_with_model("q", broken))))["intent"] == "unknown"
    docs = spark.createDataFrame([("a", "prod", 5), ("b", "dev", 6)], "service string, environment string, seconds bigint")
    assert filtered(docs).count() == 2 and filtered(docs, "prod", "a", 5, 6).count() == 1 and filtered(docs, "prod", "b").count() == 0


def test_ask_end_to_end(spark):
    rows = [(f"d{i}#c0", f"d{i}", f"T{i}", f"the queue number {i} is stuck", "logs", None, "s", "prod", "u", "{}", None) for i in range(30)]
    schema = "id string, chunk_of string, title string, text string, kind string, timestamp string, service string, environment string, source_uri string, metadata string, seconds bigint"
    chunks = spark.createDataFrame(rows, schema).withColumn("vector", hash_embedding(F.col("text")))
    answer = ask(chunks, "why is queue number 7 stuck", NOW, Extractive(), Settings(), environment="prod")
    assert answer.startswith("Most relevant: [DOC #1]")
    assert ask(chunks, "x", NOW, Extractive(), environment="none") == "No passage was found."
    assert ask(chunks.drop("vector"), "x", NOW, Extractive()).startswith("The question could not be answered")


def test_stream_merges_and_replaces_stale_chunks(spark, tmp_path):
    from tidemark.streaming.index import chunks, index_available

    schema = "row_id bigint, id string, title string, text string, source_uri string, kind string, timestamp string, service string, environment string, metadata string"
    land = lambda rows: spark.createDataFrame([(n, i, "t", x, "u", "logs", None, "s", "e", "{}") for n, i, x in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    settings = Settings(chunk_chars=5, chunk_overlap=0)
    run = lambda: sorted((r["id"], r["version"]) for r in chunks(index_available(spark, str(tmp_path / "in"), str(tmp_path / "out"), spark.read.parquet(str(tmp_path / "in")).schema, settings)).collect())
    land([(1, "a", "0123456789"), (2, "b", "xyz"), (3, "e", "")])
    assert run() == [("a#c0", 1), ("a#c1", 1), ("b#c0", 2)]
    assert run() == [("a#c0", 1), ("a#c1", 1), ("b#c0", 2)]
    land([(4, "a", "0123"), (5, "a", "01")])
    assert run() == [("a#c0", 5), ("b#c0", 2)]
    # Late and old, emptied, and late after it was emptied.
    land([(3, "a", "late and old"), (9, "b", None)])
    assert run() == [("a#c0", 5)]
    land([(8, "b", "older than the emptied one")])
    assert run() == [("a#c0", 5)]
    land([(10, "b", "new")])
    assert run() == [("a#c0", 5), ("b#c0", 10)]


def test_shared_folder_is_the_one_of_the_session(spark):
    from tidemark.session import shared_dir, written

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    df = written(spark.range(5), "x")
    assert df.count() == 5 and df.inputFiles()[0].startswith(shared_dir(spark).replace("file:///", "file:///"))


def test_written_tables_can_be_removed(spark):
    from tidemark.session import removed, written

    df = written(spark.range(5), "gone")
    path = df._tidemark_path.removeprefix("file://")
    assert os.path.isdir(path)
    removed(df)
    assert not os.path.exists(path)


def test_a_provider_embeds_the_points(spark):
    from tidemark.streaming.index import points

    df = spark.createDataFrame([(1, "a", "t", "0123456789", "u", "logs", None, "s", "e", "{}")], "row_id bigint, id string, title string, text string, source_uri string, kind string, timestamp string, service string, environment string, metadata string")
    got = points(df, Settings(chunk_chars=6, chunk_overlap=0), "row_id", lambda texts: [[float(len(t))] for t in texts]).collect()
    assert sorted((r["id"], r["vector"]) for r in got) == [("a#c0", [6.0]), ("a#c1", [4.0])]
