"""The HTTP service: ``POST /ask/plan`` and ``POST /ask``."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators.answer import ask
from tidemark.operators.planner import decode_plan, plan, plan_with_model

PORT = 5191
_UNKNOWN = {"intent": "unknown", "filters": [], "missingFields": [], "clarifyingQuestions": []}


def plan_of(spark: SparkSession, question: str, planner: Callable[[str], str] | None = None) -> dict:
    """The plan of one question: the ``planner``'s (a model that writes JSON) if it gives one,
    else the one by rules; an unknown plan if planning fails."""
    try:
        asked = spark.createDataFrame([(question,)], "question string")
        if planner is not None:
            told = spark.createDataFrame([(plan_with_model(question, planner),)], "told string").select(decode_plan(F.col("told")).alias("plan")).first()["plan"]
            if told is not None and told["intent"] not in (None, "unknown"):
                return told.asDict(recursive=True)
        return plan(asked, now=int(time.time())).first()["plan"].asDict(recursive=True)
    except Exception:
        return dict(_UNKNOWN)


def server(
    store: DataFrame | Callable[[], DataFrame], model, settings: Settings | None = None, port: int = PORT, host: str = "127.0.0.1", planner: Callable[[str], str] | None = None,
    embed: Callable[[list[str]], list[list[float]]] | None = None, spark: SparkSession | None = None,
) -> ThreadingHTTPServer:
    """A server over a store of chunks (or a function that gives the newest); call
    ``serve_forever`` on it. A body without a question, or with fields of other types, gives
    400, an unknown route 404, a missing or wrong token (if one is set) 401."""
    settings = settings or Settings()
    spark = spark or store.sparkSession
    texts = ("env", "service", "from_utc", "to_utc", "rewritten_query")

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:  # noqa: N802
            if settings.api_token and self.headers.get("Authorization") != f"Bearer {settings.api_token}":
                return self._reply(401, {"error": "unauthorized"})
            if self.path not in ("/ask", "/ask/plan"):
                return self._reply(404, {"error": "no such route"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                question = body["question"]
                if not isinstance(question, str) or not all(isinstance(body.get(k), str | None) for k in texts):
                    raise TypeError
                tags = body.get("filters") or []
                if not isinstance(tags, list) or not all(isinstance(t, str) for t in tags):
                    raise TypeError
            except (ValueError, KeyError, TypeError):
                return self._reply(400, {"error": "a JSON body with a question is needed"})
            if self.path == "/ask/plan":
                return self._reply(200, {"plan": plan_of(spark, question, planner)})
            chunks = store() if callable(store) else store
            text = ask(
                chunks, question, int(time.time()), model, settings, body.get("env"), body.get("service"), body.get("rewritten_query"), body.get("from_utc"), body.get("to_utc"), tags, embed
            )
            return self._reply(200, {"answer": text})

        def _reply(self, status: int, value: dict) -> None:
            data = json.dumps(value, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
