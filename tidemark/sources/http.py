"""A Spark data source that fetches raw responses of a monitoring system over HTTP.

    spark.dataSource.register(ObservabilitySource)
    spark.read.format("observability").options(url=..., kind="logs", from_utc=..., to_utc=...).load()

gives rows of ``kind`` and ``payload`` for the readers in ``observability.py``. Every kind is
one partition; with ``slices`` the time range of logs, incidents and metrics is cut in so
many parts that are fetched in parallel. Logs and incidents come in pages of ``page`` rows,
a row of the result each: all pages are fetched, by the cursor or offset that the response
names, else by a counted offset or by halving the time range. ``max_pages`` (per slice)
is a cap for those who want one. An error status, or a full page of a second that nothing
leads on from, fails the read.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The routes of the six kinds.
ROUTES = {
    "monitor": "/api/v1/monitor",
    "dashboard": "/api/v1/dashboard",
    "slo": "/api/v1/slo",
    "metrics": "/api/v1/metrics",
    "incident": "/api/v2/incidents/search",
    "logs": "/api/v2/logs/events/search",
}
TIMED = {"metrics", "incident", "logs"}
PAGED = {"incident", "logs"}
PAGE = 100


class _Slice(InputPartition):
    def __init__(self, kind: str, start: int, end: int) -> None:
        self.kind, self.start, self.end = kind, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def _second(self, name: str) -> int:
        # An unreadable start is an error; an unreadable end means now.
        text = self.options.get(name, "")
        try:
            return int(datetime.fromisoformat(text.replace("Z", "+00:00")).timestamp())
        except ValueError:
            if name == "from_utc":
                raise
            return int(datetime.now(UTC).timestamp())

    def partitions(self) -> list[_Slice]:
        kinds = [k.strip() for k in self.options.get("kind", ",".join(ROUTES)).split(",")]
        unknown = set(kinds) - set(ROUTES)
        if unknown:
            raise ValueError(f"unknown kinds: {sorted(unknown)}")
        parts = []
        for kind in kinds:
            if kind not in TIMED:
                parts.append(_Slice(kind, 0, 0))
                continue
            start, end = self._second("from_utc"), self._second("to_utc")
            n = max(1, int(self.options.get("slices", "1")))
            edges = [start + (end - start) * i // n for i in range(n + 1)]
            parts += [_Slice(kind, a, b) for a, b in zip(edges, edges[1:], strict=False)]
        return parts

    def read(self, part: _Slice):
        if part.kind not in PAGED:
            query = "?" + urllib.parse.urlencode({"from": part.start, "to": part.end}) if part.kind in TIMED else ""
            yield (part.kind, self._fetch(ROUTES[part.kind] + query))
            return
        most = int(self.options.get("max_pages", "0"))
        for n, text in enumerate(self._pages(part.kind, part.start, part.end), 1):
            yield (part.kind, text)
            if n == most:
                return

    def _fetch(self, route: str, ask: dict | None = None) -> str:
        headers = {"Content-Type": "application/json", **json.loads(self.options.get("headers", "{}"))}
        request = urllib.request.Request(self.options["url"].rstrip("/") + route, None if ask is None else json.dumps(ask).encode(), headers)
        with urllib.request.urlopen(request, timeout=float(self.options.get("timeout", "60"))) as response:
            return response.read().decode()

    def _pages(self, kind: str, start: int, end: int) -> Iterator[str]:
        """All pages of a time range. A full page whose next one can't be had is not
        kept: both halves of the range are fetched instead."""
        iso = lambda s: datetime.fromtimestamp(s, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        ask: dict = {"filter": {"from": iso(start), "to": iso(end)}}
        size = int(self.options.get("page", PAGE))
        if kind == "logs":
            ask["filter"]["query"] = self.options.get("query", "status:error OR status:warn")
            ask |= {"page": {"limit": size}, "sort": "-timestamp"}
        else:
            ask["page"] = {"size": size}
        text, followed = self._fetch(ROUTES[kind], ask), set()
        rows, after = _rows_and_next(kind, text)
        while True:
            if kind == "incident" and after is None and len(rows) >= size:
                after = ask["page"].get("offset", 0) + len(rows)
            halve = kind == "logs" and after is None and len(rows) >= size and not followed
            if not halve and (after is None or not rows):
                if rows or not followed:
                    yield text
                return
            if not halve:
                if after in followed:
                    raise ValueError(f"{kind}: the page after {after} leads back to itself")
                ask["page"]["cursor" if kind == "logs" else "offset"] = after
                following = self._fetch(ROUTES[kind], ask)
                more = _rows_and_next(kind, following)
                if more[0] != rows:
                    yield text
                    followed.add(after)
                    text, (rows, after) = following, more
                    continue
            # The server knows no next page, or gave the first one again.
            if followed or end - start <= 1:
                raise ValueError(f"{kind}: a full page of {size} rows from {iso(start)} to {iso(end)} and no way to the next; ask for larger pages")
            middle = (start + end) // 2
            yield from self._pages(kind, start, middle)
            yield from self._pages(kind, middle, end)
            return


def _rows_and_next(kind: str, text: str) -> tuple[list, str | int | None]:
    """The rows of a page and the cursor or offset of the next one, if the page names it."""
    value = json.loads(text)
    meta = value.get("meta") or {}
    after = (meta.get("page") or {}).get("after") if kind == "logs" else (meta.get("pagination") or {}).get("next_offset")
    return value.get("data") or [], after


class ObservabilitySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "observability"

    def schema(self) -> str:
        return "kind string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
