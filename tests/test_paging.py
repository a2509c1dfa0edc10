import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from tidemark.operators.store import VersionedStore
from tidemark.sources.http import ObservabilitySource
from tidemark.streaming.incremental import Cursor, load

END = 1_735_689_600


def second(text):
    return int(datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp())


@pytest.fixture
def web():
    """Logs and incidents in pages as ``mode`` says: named, counted (incidents) and halved
    (logs), broken on the third page."""
    state = {"mode": "named", "rows": [(i, END - 1 - i * 7) for i in range(250)], "asked": 0}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            ask = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            state["asked"] += 1
            page, kind = ask["page"], "logs" if "logs" in self.path else "incident"
            a, b = second(ask["filter"]["from"]), second(ask["filter"]["to"])
            rows = [{"id": f"{kind[0]}{i}", "attributes": {"message": "x", "title": "x", "status": "error"}} for i, t in state["rows"] if a <= t < b]
            size = page["limit"] if kind == "logs" else page["size"]
            at = 0 if state["mode"] == "ignored" else int(page.get("cursor", page.get("offset", 0)))
            value = {"data": rows[at : at + size]}
            if state["mode"] != "ignored" and at + size < len(rows) and (kind == "logs" or state["mode"] == "named"):
                value["meta"] = {"page": {"after": str(at + size)}, "pagination": {"next_offset": at + size}}
            data = json.dumps(value).encode()
            self.send_response(500 if state["mode"] == "broken" and at >= 200 else 200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{httpd.server_port}"
    yield state
    httpd.shutdown()


def reader(spark, web, **options):
    spark.dataSource.register(ObservabilitySource)
    return lambda a, b: spark.read.format("observability").options(**{"url": web["url"], "kind": "logs,incident", "from_utc": a, "to_utc": b, **options}).load()


def ids(df):
    items = F.from_json("payload", "data array<struct<id:string>>")["data"]
    return {r["id"] for r in df.select(F.explode(items).alias("x")).select("x.id").collect()}


@pytest.mark.parametrize("mode", ["named", "counted", "ignored"])
def test_every_page_is_fetched(spark, web, mode):
    web["mode"] = mode
    fetch = reader(spark, web)
    assert len(ids(fetch("2024-12-31T22:00:00Z", "2025-01-01T00:00:00Z"))) == 500


def test_a_cap_is_asked_for_and_a_full_second_is_an_error(spark, web):
    assert len(ids(reader(spark, web, max_pages="1")("2024-12-31T22:00:00Z", "2025-01-01T00:00:00Z"))) == 200
    web["mode"], web["rows"] = "ignored", [(i, END - 5) for i in range(101)]
    with pytest.raises(Exception, match="no way to the next"):
        reader(spark, web)("2024-12-31T22:00:00Z", "2025-01-01T00:00:00Z").count()


def test_the_cursor_moves_behind_all_pages_only(spark, web, tmp_path):
    root, web["mode"] = str(tmp_path / "store"), "broken"
    with pytest.raises(Exception, match="500"):
        load(spark, root, reader(spark, web), END)
    assert Cursor(spark, f"{root}/cursor").read() is None
    web["mode"] = "named"
    load(spark, root, reader(spark, web), END)
    assert VersionedStore(spark, f"{root}/points").read().select("chunk_of").distinct().count() == 500
    assert Cursor(spark, f"{root}/cursor").read() == "2025-01-01T00:00:00Z"
