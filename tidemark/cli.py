"""Command line: ``ask`` and ``plan`` (at the service, or ``ask`` over a local store), ``index``
for landed files, ``load`` for one window of the source, ``serve`` for the service."""

from __future__ import annotations

import argparse
import json
import sys
import time
import urllib.request


PLAN_PROMPT = (
    "Plan the search for a question about operations. Answer with one JSON object with the fields intent (rootCause, incident, slo, monitor, metric, logs or unknown), service, environment, "
    "monitorId, incidentId, metric, sloId, window (fromUtc, toUtc), filters, missingFields, clarifyingQuestions and rewrittenQuery; leave out what the question doesn't say."
)


def _post(route: str, body: dict) -> dict:
    from tidemark.config import Settings

    settings = Settings.from_env()
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {settings.api_token}"} if settings.api_token else {})
    request = urllib.request.Request(settings.api_url.rstrip("/") + route, json.dumps(body).encode(), headers)
    with urllib.request.urlopen(request, timeout=300) as response:
        return json.loads(response.read())


def _remote(args: argparse.Namespace) -> int:
    """Plan, and for ``ask`` then ask, at the service; flags beat what the plan infers."""
    told = _post("/ask/plan", {"question": args.question})["plan"]
    if args.verb == "plan":
        print(json.dumps(told, ensure_ascii=False, indent=1))
        return 0
    for line in (told.get("clarifyingQuestions") or []) if told.get("missingFields") else []:
        print(line, file=sys.stderr)
    span = told.get("window") or {}
    body = {
        "question": args.question, "env": args.env or told.get("environment"), "service": args.service or told.get("service"), "from_utc": span.get("fromUtc"),
        "to_utc": span.get("toUtc"), "filters": told.get("filters"), "rewritten_query": told.get("rewrittenQuery"),
    }
    print(_post("/ask", body)["answer"])
    return 0


def _run(args: argparse.Namespace) -> int:
    """``load`` and ``serve``, with the settings of the environment."""
    from tidemark.config import Settings
    from tidemark.operators.store import VersionedStore, searchable
    from tidemark.providers import Extractive, HttpModel
    from tidemark.session import get_session

    settings = Settings.from_env()
    root = args.root or settings.store
    if not root:
        print("a store is needed: --root or TIDEMARK_STORE", file=sys.stderr)
        return 2
    model = HttpModel(settings.model_url, settings.model_key, settings.embedding_model, settings.chat_model) if settings.model_url else None
    spark = get_session()
    if args.verb == "load":
        from tidemark.sources.http import ObservabilitySource
        from tidemark.streaming.incremental import load

        if not settings.source_url:
            print("a source is needed: TIDEMARK_SOURCE_URL", file=sys.stderr)
            return 2
        spark.dataSource.register(ObservabilitySource)
        source = spark.read.format("observability").options(url=settings.source_url, headers=settings.source_headers)
        span = load(spark, root, lambda a, b: source.options(from_utc=a, to_utc=b).load(), args.now or int(time.time()), settings, model.embed if model else None)
        print(*span)
        return 0
    from tidemark.service import server

    newest = lambda: searchable(VersionedStore(spark, f"{root}/points").read())
    planner = (lambda question: model.chat(PLAN_PROMPT, question, as_json=True)) if model and settings.plan_with_model else None
    service = server(newest, model or Extractive(), settings, args.port, args.host, planner, model.embed if model else None, spark)
    print(f"listening on {args.host}:{service.server_address[1]}", file=sys.stderr)
    service.serve_forever()
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name in ("ask", "plan"):
        verb = verbs.add_parser(name)
        verb.add_argument("question")
        verb.add_argument("--env")
        verb.add_argument("--service")
        if name == "ask":
            verb.add_argument("--store", help="folder of the chunk store (parquet); without it the service is asked")
            verb.add_argument("--model-url")
    verb = verbs.add_parser("index")
    verb.add_argument("source")
    verb.add_argument("root")
    verb = verbs.add_parser("load")
    verb.add_argument("--root", help="folder of the store and its cursor (TIDEMARK_STORE)")
    verb.add_argument("--now", type=int, help="end of the window in seconds since 1970")
    verb = verbs.add_parser("serve")
    verb.add_argument("--root", help="folder of the store (TIDEMARK_STORE)")
    verb.add_argument("--port", type=int, default=5191)
    verb.add_argument("--host", default="127.0.0.1")
    args = parser.parse_args(argv)

    if args.verb in ("load", "serve"):
        return _run(args)
    if args.verb != "index" and not getattr(args, "store", None):
        return _remote(args)
    from tidemark.operators.planner import plan
    from tidemark.session import get_session

    spark = get_session()
    if args.verb == "index":
        from tidemark.streaming.index import index_available

        store = index_available(spark, args.source, args.root, spark.read.parquet(args.source).schema)
        print(store.read().count() if store.versions() else 0)
        return 0
    row = plan(spark.createDataFrame([(args.question,)], "question string")).first()["plan"]
    for line in row["clarifyingQuestions"]:
        print(line, file=sys.stderr)
    from tidemark.operators.answer import ask
    from tidemark.providers import Extractive, HttpModel

    model = HttpModel(args.model_url) if args.model_url else Extractive()
    print(ask(spark.read.parquet(args.store), args.question, int(time.time()), model, environment=args.env or row["environment"], service=args.service or row["service"]))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
