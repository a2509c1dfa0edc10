import json
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.config import Settings
from tidemark.operators.embed import hash_embedding
from tidemark.providers import Extractive, HttpModel
from tidemark.service import server
from tidemark.sources.http import ObservabilitySource
from tidemark.streaming.incremental import Cursor, load
from tidemark.streaming.index import windowed_counts

RAW = {
    "/api/v1/monitor": [{"id": 1, "name": "M", "message": "m", "query": "q", "type": "t", "tags": ["service:a"]}],
    "/api/v1/dashboard": {"dashboards": [{"id": "d", "title": "D"}]},
    "/api/v1/slo": {"data": [{"id": "s", "name": "S", "type": "t", "thresholds": [{"target": 0.99}]}]},
    "/api/v1/metrics": {"metrics": ["a.b"]},
    "/api/v2/incidents/search": {"data": [{"id": "i", "attributes": {"title": "I"}}]},
    "/api/v2/logs/events/search": {"data": [{"id": "l", "attributes": {"message": "x", "status": "error"}}]},
}


@pytest.fixture
def web():
    """A stand-in for the monitoring system and the model; remembers what it was asked."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            path = self.path.split("?")[0]
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            asked.append((self.path, json.loads(body) if body else None, dict(self.headers)))
            if path == "/embeddings":
                value = {"data": [{"embedding": [0.1, 0.2]}]}
            elif path == "/chat/completions":
                value = {"choices": []} if "empty" in body.decode() else {"choices": [{"message": {"content": "hello"}}]}
            else:
                value = RAW.get(path)
            data = json.dumps(value).encode()
            self.send_response(200 if value is not None else 403)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST

        def log_message(self, *args):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", asked
    httpd.shutdown()


def test_model_client(web):
    url, asked = web
    model = HttpModel(url, "key")
    assert model.embed(["a", "b"]) == [[0.1, 0.2], []]
    assert model.chat("s", "u") == "hello"
    assert model.chat("s", "empty") == "" and model.chat("s", "empty", as_json=True) == "{}"
    assert asked[-1][1]["response_format"] == {"type": "json_object"} and asked[0][2]["Authorization"] == "Bearer key"
    with pytest.raises(urllib.error.HTTPError):
        HttpModel(url + "/nowhere").chat("s", "u")


def test_source_and_incremental_load(spark, web, tmp_path):
    url, asked = web
    spark.dataSource.register(ObservabilitySource)
    fetch = lambda a, b: spark.read.format("observability").options(url=url, from_utc=a, to_utc=b, headers='{"X-Api-Key": "k"}').load()
    root = str(tmp_path / "store")
    assert load(spark, root, fetch, 1_735_689_600) == ("2024-12-31T22:30:00Z", "2025-01-01T00:00:00Z")
    from tidemark.operators.store import VersionedStore

    ids = lambda: sorted(r["id"] for r in VersionedStore(spark, f"{root}/points").read().collect())
    assert ids() == ["dashboard_d#c0", "incident_i#c0", "log_l#c0", "metric_a_b#c0", "monitor_1#c0", "slo_s#c0"]
    assert load(spark, root, fetch, 1_735_690_200) == ("2025-01-01T00:00:00Z", "2025-01-01T00:10:00Z")
    assert len(ids()) == 6
    # Each load asks for every kind once.
    assert len(asked) == 12
    log = next(a for a in reversed(asked) if "logs" in a[0])
    assert log[1]["filter"]["from"] == "2025-01-01T00:00:00Z" and log[1]["page"] == {"limit": 100} and log[2]["X-Api-Key"] == "k"

    def broken(a, b):
        raise OSError

    with pytest.raises(OSError):
        load(spark, root, broken, 1_735_700_000)
    assert Cursor(spark, f"{root}/cursor").read() == "2025-01-01T00:10:00Z"


def test_source_slices_and_errors(spark, web):
    url, asked = web
    spark.dataSource.register(ObservabilitySource)
    read = spark.read.format("observability").options(url=url, kind="logs", from_utc="2025-01-01T00:00:00Z", to_utc="2025-01-01T04:00:00Z", slices="4")
    assert read.load().count() == 4
    for options in ({"url": url + "/x"}, {"url": url, "kind": "nothing"}, {"url": url, "from_utc": "never"}):
        with pytest.raises(Exception):  # noqa: B017
            spark.read.format("observability").options(**{"kind": "logs", "from_utc": "2025-01-01T00:00:00Z", "to_utc": "?", **options}).load().count()


def test_service_and_command_line(spark, monkeypatch, capsys):
    schema = "id string, chunk_of string, title string, text string, kind string, timestamp string, service string, environment string, source_uri string, metadata string, seconds bigint"
    rows = [(f"d{i}#c0", f"d{i}", f"T{i}", f"queue {i} is stuck", "logs", None, "payment-api", "prod", "u", "{}", None) for i in range(5)]
    chunks = spark.createDataFrame(rows, schema).withColumn("vector", hash_embedding(F.col("text")))
    httpd = server(chunks, Extractive(), Settings(api_token="t"), port=0)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{httpd.server_port}"
    monkeypatch.setenv("TIDEMARK_API_URL", url)
    with pytest.raises(urllib.error.HTTPError):
        cli.main(["plan", "x"])
    monkeypatch.setenv("TIDEMARK_API_TOKEN", "t")
    assert cli.main(["plan", "why is payment-api slow in prod?"]) == 0
    assert json.loads(capsys.readouterr().out)["service"] == "payment-api"
    assert cli.main(["ask", "queue 3", "--env", "prod"]) == 0
    out = capsys.readouterr()
    assert out.out.startswith("Most relevant: [DOC #1] T3") and "Which service" in out.err
    for path, body, status in (("/ask", b"{}", 400), ("/ask", b"broken", 400), ("/other", b"{}", 404)):
        with pytest.raises(urllib.error.HTTPError) as error:
            urllib.request.urlopen(urllib.request.Request(url + path, body, {"Authorization": "Bearer t"}))
        assert error.value.code == status
    httpd.shutdown()


class Echo:
    """A model that tells how many passages it was given, and plans."""

    def chat(self, system, user, as_json=False):
        return '{"intent": "logs", "service": "from-model"}' if as_json else str(user.count("[DOC #"))


def test_a_request_is_held_to_its_range_and_filters(spark):
    schema = "id string, chunk_of string, title string, text string, kind string, timestamp string, service string, environment string, source_uri string, metadata string, seconds bigint"
    rows = [(f"d{i}#c0", f"d{i}", f"T{i}", f"queue {i} is stuck", "logs", None, "a", "prod", "u", '{"tags": ["team:x"]}' if i % 2 else "{}", 1_735_689_600 + i * 3600 if i < 8 else None) for i in range(10)]
    chunks = spark.createDataFrame(rows, schema).withColumn("vector", hash_embedding(F.col("text")))
    model = Echo()
    httpd = server(lambda: chunks, model, port=0, spark=spark, planner=lambda q: model.chat("", q, as_json=True) if "model" in q else "broken")
    threading.Thread(target=httpd.serve_forever, daemon=True).start()

    def post(path, **body):
        return json.loads(urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{httpd.server_port}{path}", json.dumps(body).encode())).read())

    asked = lambda **more: post("/ask", question="queue", **more)["answer"]
    assert asked() == "10" and asked(from_utc="2025-01-01T02:00:00Z") == "6" and asked(from_utc="01/01/2025 05:00:00 AM", to_utc="2025-01-01T02:00:00Z") == "3"
    assert asked(filters=["team:x", "env:prod", ""]) == "5" and asked(filters=["team:y"]) == "0" and asked(to_utc="1735689600") == "0"
    assert "no instant: soon" in asked(from_utc="soon")
    for bad in ({"env": 1}, {"filters": "x"}, {"from_utc": []}):
        with pytest.raises(urllib.error.HTTPError) as error:
            asked(**bad)
        assert error.value.code == 400
    assert post("/ask/plan", question="ask the model")["plan"]["service"] == "from-model"
    assert post("/ask/plan", question="logs of cart-api in the last 2 hours")["plan"]["service"] == "cart-api"
    httpd.shutdown()


def test_windows_of_questions(spark):
    from tidemark.operators.planner import plan

    cases = {
        "errors from 2025-01-01T00:00:00Z to 2025-01-01 02:00": ("2025-01-01T00:00:00Z", "2025-01-01 02:00"), "since 2025-01-01T00:00:00Z": ("2025-01-01T00:00:00Z", None),
        "what broke in the last 3 hours?": ("2025-01-01T09:00:00Z", "2025-01-01T12:00:00Z"), "past day": ("2024-12-31T12:00:00Z", "2025-01-01T12:00:00Z"),
        "incidents Yesterday": ("2024-12-31T00:00:00Z", "2025-01-01T00:00:00Z"), "why?": (None, None), None: (None, None),
    }
    df = plan(spark.createDataFrame([(q,) for q in cases], "question string"), now=1_735_732_800)
    assert {r["question"]: (r["plan"]["window"]["fromUtc"], r["plan"]["window"]["toUtc"]) for r in df.collect()} == cases


def test_loading_from_the_command_line(spark, web, monkeypatch, capsys, tmp_path):
    from tidemark.operators.store import VersionedStore, searchable

    assert cli.main(["load"]) == 2 and cli.main(["serve"]) == 2
    monkeypatch.setenv("TIDEMARK_STORE", str(tmp_path))
    assert cli.main(["load"]) == 2
    monkeypatch.setenv("TIDEMARK_SOURCE_URL", web[0])
    assert cli.main(["load", "--now", "1735689600"]) == 0
    assert capsys.readouterr().out == "2024-12-31T22:30:00Z 2025-01-01T00:00:00Z\n"
    rows = {r["id"]: r for r in searchable(VersionedStore(spark, f"{tmp_path}/points").read()).collect()}
    assert len(rows) == 6 and rows["monitor_1#c0"]["service"] == "a" and rows["metric_a_b#c0"]["seconds"] == 1_735_689_600


def test_windowed_counts(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:50:00"), ("b", "2024-01-01 03:00:00"), ("b", "2024-01-01 08:00:00")], "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = windowed_counts(stream, "t", ["k"]).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["k"], r["n"]) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1), ("b", 1)]
