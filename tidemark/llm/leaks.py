"""Problem 7: evaluation passages inside a corpus.

Method: an FM-index per shard of the corpus (an Arrow batch). The shard's words are
projected on the words of the evaluation items; stretches of such words that are
shorter than the shortest phrase cannot hold one and are left out. The index is a
suffix array by prefix doubling, its Burrows-Wheeler transform in a wavelet matrix,
and every eighth suffix position. All phrases (each run of ``window`` words of an item,
or the whole item if it is shorter) are searched backwards at once, occurrences are
located from the sampled positions, and overlapping ones are merged to removal spans.

Items are matched in groups by their hash, of about ``GROUP_CHARS`` characters each, so the
phrases held and shipped at once are bounded however many items there are; every group is
one pass over the corpus. Words are runs of letters and digits, compared by shape without
case; tags, comments, character references and the targets of links are dropped, however
long they are.

Defined results: null or empty texts and items without words leak nothing; repeated
items and documents are reported each; documents of any length are searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.lookalike import caseless
from tidemark.session import written

WINDOW = 12
SAMPLE = 8
#: Characters of items in one group, about.
GROUP_CHARS = 3_000_000
_WORD = re.compile(r"[^\W_]+")
_MARKUP = re.compile(r"</?[A-Za-z][^<>]*>|&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]+|#[Xx][0-9A-Fa-f]+);|\]\([^()\s]*\)")


def _plain(text: str) -> str:
    """The text without markup, in one scan."""
    if "<!--" in text:
        parts, at = [], 0
        while (start := text.find("<!--", at)) >= 0 and (end := text.find("-->", start + 4)) >= 0:
            parts += [text[at:start], " "]
            at = end + 3
        text = "".join([*parts, text[at:]])
    return _MARKUP.sub(" ", text)


def words_of(text: str) -> list[str]:
    """The words that count in a comparison."""
    if "<" in text or "&" in text or "](" in text:
        text = _plain(text)
    return _WORD.findall(caseless(text))


class Phrases:
    """The distinct phrases of a block of items, as rows of word numbers (from 1)."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int) -> None:
        self.vocabulary: dict[str, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                found.setdefault(tuple(ids[i : i + n]), set()).add(item)
        self.items = [sorted(v) for v in found.values()]
        self.length = np.array([len(k) for k in found], np.int64)
        self.shortest = int(self.length.min()) if found else 0
        #: Right-aligned, so that the last word of every phrase is in the last column.
        self.words = np.zeros((len(found), int(self.length.max()) if found else 0), np.int64)
        for row, k in enumerate(found):
            self.words[row, self.words.shape[1] - len(k) :] = k


class FMIndex:
    """Backward search and location over a sequence of small integers, 0 included."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE) -> None:
        text = np.concatenate([text + 1, [0]]).astype(np.int64)  # 0 ends the text
        self.n = n = len(text)
        rank, width = text.copy(), 1
        order = np.argsort(rank, kind="stable")
        while True:
            follow = np.zeros(n, np.int64)
            follow[: n - width] = rank[width:] + 1
            key = rank * (n + int(text.max()) + 2) + follow
            order = np.argsort(key, kind="stable")
            steps = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = steps
            width *= 2
            if steps[-1] == n - 1 or width >= 2 * n:
                break
        bwt = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.levels: list[tuple[int, np.ndarray, int]] = []  # shift, ones before, zeros in all
        row = bwt
        self.bits = max(1, int(text.max()).bit_length())
        for shift in range(self.bits - 1, -1, -1):
            bit = (row >> shift) & 1
            ones = np.concatenate([[0], np.cumsum(bit)])
            self.levels.append((shift, ones, n - int(ones[-1])))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.bwt = bwt
        marked = order % sample == 0
        self.marked = marked
        self.samples = np.where(marked, order, -1)

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``place`` in the transform."""
        start, end = np.zeros_like(place), place
        for shift, ones, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            s1, e1 = ones[start], ones[end]
            start, end = np.where(one, zeros + s1, start - s1), np.where(one, zeros + e1, end - e1)
        return end - start

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with each (right-aligned) phrase."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        top = len(self.first) - 2
        live = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1):
            live = live[(length[live] >= back) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = phrases[live, -back] + 1
            known = symbol <= top
            low[live[~known]], high[live[~known]] = 0, 0
            live, symbol = live[known], symbol[known]
            low[live], high[live] = self.first[symbol] + self.rank(symbol, low[live]), self.first[symbol] + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back to the next sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.marked[rows])
        while len(open_):
            at = rows[open_]
            symbol = self.bwt[at]
            rows[open_] = self.first[symbol] + self.rank(symbol, at)
            steps[open_] += 1
            open_ = open_[~self.marked[rows[open_]]]
        return self.samples[rows] + steps


def _shard_hits(bodies: list[str], phrases: Phrases) -> list[tuple[int, int, int, int]]:
    """(row, phrase, first word, word behind the last) of every occurrence."""
    get = phrases.vocabulary.get
    parts, rows, places = [], [], []
    for row, body in enumerate(bodies):
        ids = np.array([get(w, 0) for w in words_of(body)], np.int64)
        if len(ids) < phrases.shortest:
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]])))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if b - a >= phrases.shortest:
                parts.append(np.concatenate([ids[a:b], [0]]))
                rows.append(row)
                places.append(a)
    if not parts:
        return []
    index = FMIndex(np.concatenate(parts))
    low, high = index.search(phrases.words, phrases.length)
    found = np.flatnonzero(high > low)
    which = np.repeat(found, (high - low)[found])
    offsets = np.arange(len(which)) - np.repeat(np.cumsum((high - low)[found]) - (high - low)[found], (high - low)[found])
    at = index.locate(low[which] + offsets)
    starts = np.cumsum([0, *[len(p) for p in parts[:-1]]])
    part = np.searchsorted(starts, at, side="right") - 1
    first = np.array(places)[part] + at - starts[part]
    return list(zip(np.array(rows)[part].tolist(), which.tolist(), first.tolist(), (first + phrases.length[which]).tolist(), strict=True))


def leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, window: int = WINDOW) -> DataFrame:
    """``key``, ``item_id``, ``word_from``, ``word_to``: the spans (in words of the document)
    that every item has in a document; overlapping and touching spans are merged."""
    told = items.select(F.col(item_key).cast("bigint").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    groups = max(1, -(-(told.agg(F.sum(F.length("text"))).first()[0] or 0) // GROUP_CHARS))
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null and text <> ''")
    kind = source.schema["id"].dataType.simpleString()
    parts = []
    for g in range(groups):
        rows = told.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g).collect()
        part = _block(source, kind, Phrases([(r[0], words_of(r[1])) for r in sorted(rows)], window))
        # One group is enough as a rule; more of them must not be held at once.
        parts.append(part if groups == 1 else written(part, "leaks"))
    return reduce(DataFrame.unionAll, parts).withColumnRenamed("id", key)


def _block(source: DataFrame, kind: str, phrases: Phrases) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(1).to_pylist()
            spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
            if len(phrases.items):
                for row, phrase, a, b in _shard_hits(bodies, phrases):
                    for item in phrases.items[phrase]:
                        spans.setdefault((row, item), []).append((a, b))
            rows = []
            for (row, item), found in sorted(spans.items()):
                merged: list[list[int]] = []
                for a, b in sorted(found):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                rows += [(row, item, a, b) for a, b in merged]
            columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0])), *(pa.array(c) for c in columns[1:])], names=["id", "item_id", "word_from", "word_to"])

    return source.mapInArrow(run, f"id {kind}, item_id bigint, word_from bigint, word_to bigint")


def removal_spans(found: DataFrame, key: str) -> DataFrame:
    """Per document the spans to remove, merged over all items, as an array."""
    spans = F.array_sort(F.collect_set(F.struct(F.col("word_from").alias("a"), F.col("word_to").alias("b"))))
    kind = "array<struct<a:bigint,b:bigint>>"
    merged = F.aggregate(
        spans,
        F.lit(None).cast(kind),
        lambda acc, s: F.when(acc.isNull(), F.array(s)).when(
            s["a"] <= F.element_at(acc, -1)["b"],
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], s["b"]).alias("b")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return found.groupBy(key).agg(merged.alias("spans"), F.countDistinct("item_id").alias("n_items"))
