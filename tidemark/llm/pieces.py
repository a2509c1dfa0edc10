"""Problem 4: texts over a limit become overlapping pieces cut at natural boundaries.

Method: agglomerative merging. A text falls into atoms at its natural boundaries
(sentence and line ends; words inside an atom that is itself too long; equal steps only
inside an unbroken stretch longer than the limit). Adjacent atoms wait in a heap and the
weakest boundary is merged first, as long as the merged size plus the overlap fits. Each
piece then starts up to ``overlap`` characters inside the piece before, at the start of
the word nearest to that distance. A merge between two pieces costs a logarithm of the
number of atoms, so very long texts stay cheap.

Defined results: null and empty texts give no piece; a text within the limit is one
piece; nothing is stripped, so the pieces without their overlaps are the text; an
unbroken stretch is never cut before a combining mark or joiner; behind the first piece
sentences, lines and stretches over the limit less the overlap are split, too, so every
piece has room for the overlap.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1800, 200
#: Ends of atoms and the strength of the boundary behind them.
_BREAK = re.compile(r"(?P<p>\n[^\S\n]*\n\s*)|(?P<l>\n\s*)|(?P<s>[.!?…]+[\"')\]]*\s+|[。！？]+\s*)")
_CLAUSE = re.compile(r"[,;:、，；：—–)\]}]+\s+")
_WORD = re.compile(r"\s+")
_START = re.compile(r"(?<=\s)\S")
_STRENGTH = {"p": 5, "l": 4, "s": 3}
_CLAUSE_STRENGTH, _WORD_STRENGTH, _FORCED = 2, 1, 0


def _joins(ch: str) -> bool:
    return unicodedata.combining(ch) > 0 or ch in "‍︎️" or "\U0001f3fb" <= ch <= "\U0001f3ff"


def _cut(text: str, start: int, end: int) -> int:
    """The last place not after ``end`` where a stretch may be cut."""
    at = end
    while at > start + 1 and at < len(text) and (_joins(text[at]) or text[at - 1] == "‍"):
        at -= 1
    return at if at > start + 1 else end


def atoms(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(end, strength of the boundary behind) of every atom."""
    out: list[tuple[int, int]] = []
    step = max(1, limit - overlap)

    def split(start: int, end: int, strength: int, finer: list[tuple[re.Pattern, int]]) -> None:
        # Only the start of the text needs no room for an overlap.
        if end - start <= (step if start else limit):
            out.append((end, strength))
            return
        if finer:
            pattern, weak = finer[0]
            at = start
            for m in pattern.finditer(text, start, end):
                if at < m.end() < end:
                    split(at, m.end(), weak, finer[1:])
                    at = m.end()
            split(at, end, strength, finer[1:])
            return
        at = start
        while end - at > step:
            at = _cut(text, at, at + step)
            out.append((at, _FORCED))
        out.append((end, strength))

    at = 0
    for m in _BREAK.finditer(text):
        if m.end() < len(text):
            split(at, m.end(), _STRENGTH[m.lastgroup], [(_CLAUSE, _CLAUSE_STRENGTH), (_WORD, _WORD_STRENGTH)])
            at = m.end()
    split(at, len(text), 6, [(_CLAUSE, _CLAUSE_STRENGTH), (_WORD, _WORD_STRENGTH)])
    return out


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start with overlap, start, end) of every piece of the text."""
    if not text:
        return []
    if len(text) <= limit:
        return [(0, 0, len(text))]
    found = atoms(text, limit, overlap)
    ends = [e for e, _ in found]
    n = len(ends)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    start = [0, *ends[:-1]]
    alive = [True] * n
    # A boundary is named by the segment in front of it, which stays when it is merged.
    # Cutting a stretch was the last resort; merging never undoes what can't fit.
    heap = [(found[i][1], ends[i + 1] - start[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        strength, size, a, b = heapq.heappop(heap)
        if not (alive[a] and b < n and alive[b]) or right[a] != b or ends[b] - start[a] != size:
            continue
        if size + (overlap if start[a] else 0) > limit:
            continue
        alive[b] = False
        ends[a] = ends[b]
        right[a] = right[b]
        if right[b] < n:
            left[right[b]] = a
            heapq.heappush(heap, (found[right[b] - 1][1], ends[right[b]] - start[a], a, right[b]))
        if left[a] >= 0:
            heapq.heappush(heap, (found[a - 1][1], ends[a] - start[left[a]], left[a], a))
    out: list[tuple[int, int, int]] = []
    for i in range(n):
        if alive[i]:
            out.append((_begin(text, out[-1][0] if out else 0, start[i], ends[i], limit, overlap), start[i], ends[i]))
    return out


def _begin(text: str, least: int, start: int, end: int, limit: int, overlap: int) -> int:
    room = min(limit - (end - start), start - least)
    if room <= 0 or overlap <= 0:
        return start
    aim = start - min(overlap, room)
    lo, hi = max(start - room, aim - overlap // 2), min(start, aim + overlap // 2)
    best = min((m.start() for m in _START.finditer(text, max(0, lo - 1), hi) if lo <= m.start() < start), key=lambda p: abs(p - aim), default=None)
    if best is not None:
        return best
    while aim < start and _joins(text[aim]):
        aim += 1
    return aim


def split(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True, also: str | None = None) -> DataFrame:
    """One row per piece: ``key``, ``piece_id`` (``<key>#c<n>``), ``piece_no``,
    ``piece_start`` (with overlap), ``core_start``, ``core_end``, ``forced`` (1: the merging
    left a boundary of the piece inside an unbroken stretch over the limit) and ``piece_text``.
    ``also`` is a column of whole numbers to keep."""
    unbroken = re.compile(rf"\S{{{limit + 1},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, kept = (batch.column(i).to_pylist() for i in range(3))
            rows: list[tuple] = []
            size = 0
            for i, body, row in zip(ids, texts, kept, strict=True):
                stretches = [m.span() for m in unbroken.finditer(body)] if len(body) > limit else []
                for n, (a, b, e) in enumerate(pieces(body, limit, overlap)):
                    forced = int(any(x < cut < y for x, y in stretches for cut in (b, e)))
                    rows.append((i, f"{i}#c{n}", n, a, b, e, forced, body[a:e] if with_text else None, row))
                    size += e - a
                if size > 8_000_000:
                    yield table(rows)
                    rows, size = [], 0
            yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.int32(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, kinds, strict=True)], names=[n for n, _ in names])

    names = [("key", "string"), ("piece_id", "string"), ("piece_no", "bigint"), ("piece_start", "bigint"), ("core_start", "bigint"), ("core_end", "bigint"), ("forced", "int"), ("piece_text", "string"), (also or "also", "bigint")]
    number = F.col(also).cast("bigint") if also else F.lit(None).cast("bigint")
    source = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), number.alias("also")).where("key is not null and text <> ''")
    out = source.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in names))
    return out if also else out.drop("also")


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of every key by ``order`` (ascending; the last column must be
    unique). Only the few rows that lose take part in a join, so texts stay in place."""
    row = order[-1]
    light = df.select(key, *order).where(F.col(key).isNotNull())
    last = light.groupBy(key).agg(F.max(F.struct(*order)).alias("last"), F.count("*").alias("n")).where("n > 1")
    losers = light.join(last, key).where(F.struct(*order) < F.col("last")).select(row)
    return df.where(F.col(key).isNotNull()).join(losers, row, "left_anti")
