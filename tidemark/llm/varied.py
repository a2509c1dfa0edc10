"""Problem 6: a varied choice of given size.

Method: minimum-cost flow quotas. The hits of a request are grouped to combinations of
kind and story; stories are hits whose word sets are alike (cosine over ``STORY``) or
that are chunks of one parent. A flow of ``take`` units runs from the kinds (each with a
balanced target and rising costs beyond it) through the combinations to the stories
(rising costs for each further use). The n-th unit of a combination earns the n-th best
score in it. The cheapest flow gives the quota of every combination, which is filled by
rank: score, then id.

A request of more than ``BLOCK`` hits gets its stories from a distributed join: its hits
fall into parts, each two parts meet in a task of about ``BLOCK`` hits, and the links found
are joined to components. Then hits that no cheapest flow needs are left out: of a kind and
story only the best ``take`` can be used, and of a kind only the ``take`` stories with the
best first hits matter (the units of another story could go to first hits of those that are
unused, for no less score and no more cost). Thus no task holds an unbounded request, and
the choice costs the same as the one from all hits. Smaller requests are thinned by the same
rule, so the choice doesn't depend on ``BLOCK``.

Defined results: repeated rows of an id count once (best score); null and NaN scores
rank last and earn nothing; null or blank kinds are one kind; null texts are stories of
their own; a request with fewer hits than ``take`` gets them all; ``take`` null means 16
and below 1 means none; requests unknown to the request table get none.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import removed, written

STORY = 0.5
#: Hits that meet in one task, and words of them that are compared at once.
BLOCK, WORDS = 2000, 4096
DEFAULT_TAKE = 16
#: More than any request has: all of its hits with their stories.
EVERYTHING = 2_000_000_000


class Costs(NamedTuple):
    """What the flow weighs against scores, in their unit; a caller sets them for its own data."""

    #: The second use of a story, and what each further one costs more.
    reuse_first: float = 0.35
    reuse_step: float = 0.25
    #: A unit of a kind beyond its balanced target, growing by this each.
    overuse_step: float = 0.04
    #: The reward of a kind's first hit.
    new_kind: float = 0.3


def stories(texts: list[str | None], parents: list[str | None]) -> list[int]:
    """The story of every hit, named by its first one: linked by alike word sets or a common parent."""
    n = len(texts)
    head = list(range(n))

    def find(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    def link(i: int, j: int) -> None:
        i, j = find(i), find(j)
        head[max(i, j)] = min(i, j)

    sets = [set((t or "").lower().split()) for t in texts]
    held = Counter(w for s in sets for w in s)
    # Words of one hit only are shared by none.
    numbers = {w: k for k, w in enumerate(w for w, m in held.items() if m > 1)}
    size = np.array([len(s) for s in sets], np.float64)
    rows = np.array([i for i, s in enumerate(sets) for w in s if w in numbers], np.int64)
    cols = np.array([numbers[w] for s in sets for w in s if w in numbers], np.int64)
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    shared = np.zeros((n, n), np.float32) if len(cols) else None
    for at in range(0, len(numbers), WORDS):
        # The product of the hit-word matrix with itself, some words at a time.
        lo, hi = np.searchsorted(cols, [at, at + WORDS])
        m = np.zeros((n, min(WORDS, len(numbers) - at)), np.float32)
        m[rows[lo:hi], cols[lo:hi] - at] = 1.0
        shared += m @ m.T
    if shared is not None:
        # Squares, as counts of words are exact: the result can't depend on rounding.
        alike = (shared > 0) & (shared.astype(np.float64) ** 2 >= STORY * STORY * size[:, None] * size[None, :])
        for i, j in zip(*np.nonzero(np.triu(alike, 1)), strict=True):
            link(int(i), int(j))
    first: dict[str, int] = {}
    for i, p in enumerate(parents):
        if p is not None:
            link(first.setdefault(p, i), i)
    return [find(i) for i in range(n)]


def _worth(score: float | None) -> float:
    return 0.0 if score is None or math.isnan(score) else float(score)


def _ranked(hits: list[dict]) -> dict[tuple[str, str], list[dict]]:
    combos: dict[tuple[str, str], list[dict]] = {}
    for h in hits:
        combos.setdefault((h["kind"], h["story"]), []).append(h)
    for rows in combos.values():
        rows.sort(key=_rank)
    return combos


def _rank(h: dict) -> tuple:
    missing = h["score"] is None or math.isnan(h["score"])
    return (missing, -_worth(h["score"]), h["id"])


def quotas(scores: dict[tuple[str, int | str], list[float]], take: int, costs: Costs = Costs()) -> dict[tuple[str, int | str], int]:
    """How many hits of each (kind, story) the cheapest flow of ``take`` units takes."""
    kinds = sorted({k for k, _ in scores})
    told = sorted({s for _, s in scores})
    target = math.ceil(take / max(1, len(kinds)))
    # Nodes: source 0, kinds, stories, sink. An arc keeps its flow; the cost of one more
    # (or one less) unit follows from it, as all costs are convex.
    kn = {k: 1 + i for i, k in enumerate(kinds)}
    sn = {s: 1 + len(kinds) + i for i, s in enumerate(told)}
    sink = 1 + len(kinds) + len(told)
    arcs: list[tuple[int, int, list[float]]] = []
    limit = min(take, sum(len(v) for v in scores.values()))
    for k in kinds:
        arcs.append((0, kn[k], [(-costs.new_kind if i == 0 else 0.0) + costs.overuse_step * max(0, i + 1 - target) for i in range(limit)]))
    for (k, s), row in sorted(scores.items()):
        arcs.append((kn[k], sn[s], [-x for x in row[:limit]]))
    for s in told:
        room = sum(len(v) for (_, t), v in scores.items() if t == s)
        arcs.append((sn[s], sink, [0.0 if i == 0 else costs.reuse_first + costs.reuse_step * (i - 1) for i in range(min(limit, room))]))
    flow = [0] * len(arcs)
    for _ in range(limit):
        far = [math.inf] * (sink + 1)
        far[0] = 0.0
        came: list[tuple[int, int] | None] = [None] * (sink + 1)
        changed = True
        while changed:
            changed = False
            for e, (u, v, cost) in enumerate(arcs):
                f = flow[e]
                if f < len(cost) and far[u] + cost[f] < far[v] - 1e-12:
                    far[v], came[v], changed = far[u] + cost[f], (e, 1), True
                if f > 0 and far[v] - cost[f - 1] < far[u] - 1e-12:
                    far[u], came[u], changed = far[v] - cost[f - 1], (e, -1), True
        if far[sink] == math.inf:
            break
        node = sink
        while node != 0:
            e, way = came[node]
            flow[e] += way
            node = arcs[e][0] if way > 0 else arcs[e][1]
    return {key: flow[len(kinds) + i] for i, key in enumerate(sorted(scores))}


def pick(hits: list[dict], take: int, costs: Costs = Costs()) -> list[dict]:
    """The chosen hits of one request with their stories, best first."""
    if take < 1 or not hits:
        return []
    if len(hits) <= take:
        return sorted(hits, key=_rank)
    combos = _thinned(_ranked(hits), take)
    got = quotas({c: [_worth(h["score"]) for h in rows] for c, rows in combos.items()}, take, costs)
    out = [h for c, rows in combos.items() for h in rows[: got[c]]]
    return sorted(out, key=_rank)


def _thinned(combos: dict[tuple[str, str], list[dict]], take: int) -> dict[tuple[str, str], list[dict]]:
    """What a cheapest flow can need, by the same rule for a request of any size: the best
    ``take`` hits of a combination, and of a kind the ``take`` combinations with the best
    first hits, with those that hold a hit worth more than the last of these."""
    combos = {c: rows[:take] for c, rows in combos.items()}
    out = {}
    for kind in {k for k, _ in combos}:
        own = sorted((c for c in combos if c[0] == kind), key=lambda c: (-_worth(combos[c][0]["score"]), c[1]))
        least = _worth(combos[own[take - 1]][0]["score"]) if len(own) >= take else -math.inf
        out |= {c: combos[c] for r, c in enumerate(own) if r < take or max(_worth(h["score"]) for h in combos[c]) > least}
    return out


def select(hits: DataFrame, requests: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """``request_id``, ``id``, ``kind``, ``score``, ``story``, ``place``: the choice for every
    request. ``hits`` as delivered, ``requests`` with ``request_id`` and ``take``."""
    kind = F.coalesce(F.nullif(F.regexp_replace(F.lower("kind"), r"[^\p{L}\p{N}]", ""), F.lit("")), F.lit("unknown"))
    take = requests.where("request_id is not null").groupBy("request_id").agg(F.coalesce(F.max("take"), F.lit(DEFAULT_TAKE)).alias("take"))
    clean = hits.where("request_id is not null and id is not null").select(
        "request_id", F.col("id").cast("string").alias("id"), F.col("chunk_of").cast("string").alias("parent"), F.col("score").cast("float").alias("score"), kind.alias("kind"), "text"
    )
    # One row per id: the best score, then the smallest text, so repeats don't matter.
    score = F.when(F.col("score").isNotNull() & ~F.isnan("score"), F.col("score"))
    clean = clean.withColumn("score", score).groupBy("request_id", "id").agg(
        F.max(F.struct("score", "kind", "text", "parent")).alias("h")
    ).select("request_id", F.struct("id", "h.parent", "h.score", "h.kind", "h.text").alias("hit"))
    sizes = clean.groupBy("request_id").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    hit = F.struct("hit.id", "hit.parent", "hit.score", "hit.kind", "hit.text", F.lit(None).cast("string").alias("story"))
    names = ["request_id", "id", "kind", "score", "story", "place"]
    all_of = None
    if sizes.isEmpty():
        whole = clean.select("request_id", hit.alias("hit"))
    else:
        sizes = written(sizes, "hits")
        large = written(clean.join(sizes, "request_id").join(take.where("take > 0"), "request_id"), "hits")
        told = large.select("request_id", "n", "take", "hit.id", "hit.kind", "hit.score").join(_labels(large), ["request_id", "id"], "left").withColumn("story", F.coalesce("story", "id"))
        whole = clean.join(sizes, "request_id", "left_anti").select("request_id", hit.alias("hit")).unionAll(_needed(told.where("n > take")))
        # Nothing is to be chosen where all are taken; no task needs the whole request.
        place = F.row_number().over(W.partitionBy("request_id").orderBy(F.desc_nulls_last("score"), "id"))
        all_of = told.where("n <= take").withColumn("place", place).select(*names)
    whole = whole.groupBy("request_id").agg(F.collect_list("hit").alias("hits")).join(take, "request_id")
    ddl = f"request_id {clean.schema['request_id'].dataType.simpleString()}, id string, kind string, score float, story string, place int"
    out = whole.select("request_id", "take", "hits").mapInArrow(lambda batches: _picked(batches, costs), ddl)
    return out if all_of is None else out.unionAll(all_of)


def quality(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """What the choice costs and gains per request: ``n_chosen``; ``n_stories`` and ``n_kinds``
    in it and in the same number of best-scored hits (``top_...``), and both mean scores."""
    chosen = select(hits, requests)
    everything = requests.where("request_id is not null").groupBy("request_id").agg(F.lit(EVERYTHING).alias("take"))
    told = select(hits, everything).select("request_id", "id", "kind", "story", "score")
    size = chosen.groupBy("request_id").agg(F.count("*").alias("n"))
    order = W.partitionBy("request_id").orderBy(F.desc_nulls_last("score"), "id")
    top = told.join(size, "request_id").withColumn("r", F.row_number().over(order)).where("r <= n")
    sums = lambda df, p: df.groupBy("request_id").agg(
        F.count("*").alias(f"{p}n_chosen"), F.countDistinct("story").alias(f"{p}n_stories"), F.countDistinct("kind").alias(f"{p}n_kinds"), F.round(F.avg("score"), 6).alias(f"{p}mean_score")
    )
    return sums(chosen, "").join(sums(top, "top_").drop("top_n_chosen"), "request_id")


def _labels(large: DataFrame, rounds: int = 500) -> DataFrame:
    """``request_id``, ``id``, ``story`` of the hits that have links: the smallest id of the story."""
    parts = F.ceil(2 * F.col("n") / BLOCK)
    met = large.select("request_id", "hit.id", "hit.text", F.pmod(F.xxhash64("hit.id"), parts).alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("other")).where("part <> other")
    met = met.groupBy("request_id", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y")).agg(F.collect_list(F.struct("id", "text")).alias("hits"))
    links = met.select("request_id", "hits").mapInArrow(_linked, f"request_id {large.schema['request_id'].dataType.simpleString()}, u string, v string")
    one = large.where("hit.parent is not null").groupBy("request_id", "hit.parent").agg(F.min("hit.id").alias("u"))
    chunks = large.select("request_id", "hit.parent", F.col("hit.id").alias("v")).join(one, ["request_id", "parent"]).where("u <> v").select("request_id", "u", "v")
    links = links.unionAll(chunks)
    links = written(links.unionAll(links.select("request_id", "v", "u")).distinct(), "hits-links")
    labels = last = written(links.select("request_id", "u", F.col("u").alias("label")).distinct(), "hits-labels")
    for _ in range(rounds):
        lower = links.join(labels.select("request_id", F.col("u").alias("v"), "label"), ["request_id", "v"]).groupBy("request_id", "u").agg(F.min("label").alias("near"))
        best = labels.join(lower, ["request_id", "u"]).select("request_id", "u", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        # Pointer jumping: take the label of one's label.
        jump = best.select("request_id", F.col("u").alias("label"), F.col("label").alias("far"))
        after = written(best.join(jump, ["request_id", "label"]).select("request_id", "u", F.least("label", "far").alias("label"), "was"), "hits-labels")
        removed(last)
        last, labels = after, after.select("request_id", "u", "label")
        if after.where("label <> was").isEmpty():
            return labels.select("request_id", F.col("u").alias("id"), F.col("label").alias("story"))
    raise RuntimeError(f"stories not settled after {rounds} rounds")


def _needed(hits: DataFrame) -> DataFrame:
    """``request_id`` and ``hit`` with its story: those that a cheapest flow can need."""
    combo = W.partitionBy("request_id", "kind", "story")
    hits = hits.withColumn("place", F.row_number().over(combo.orderBy(F.desc_nulls_last("score"), "id"))).where("place <= take")
    worth = F.coalesce("score", F.lit(0.0).cast("float"))
    # Below zero a null score is worth more than the hits ranked before it.
    tops = hits.groupBy("request_id", "kind", "story", "take").agg(F.max(F.when(F.col("place") == 1, worth)).alias("first"), F.max(worth).alias("most"))
    tops = tops.withColumn("r", F.row_number().over(W.partitionBy("request_id", "kind").orderBy(F.desc("first"), "story")))
    tops = tops.withColumn("least", F.max(F.when(F.col("r") == F.col("take"), F.col("first"))).over(W.partitionBy("request_id", "kind"))).where("r <= take or most > least")
    kept = hits.join(tops.select("request_id", "kind", "story"), ["request_id", "kind", "story"], "left_semi")
    none = F.lit(None).cast("string")
    return kept.select("request_id", F.struct("id", none.alias("parent"), "score", "kind", none.alias("text"), "story").alias("hit"))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            head = stories([h["text"] for h in r["hits"]], [None] * len(r["hits"]))
            rows += [(r["request_id"], r["hits"][i]["id"], h["id"]) for i, h in zip(head, r["hits"], strict=True) if r["hits"][i] is not h]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        kinds = [batch.schema.field("request_id").type, pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, kinds, strict=True)], names=["request_id", "u", "v"])


def _picked(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            hits = sorted(r["hits"], key=lambda h: h["id"])
            if hits[0]["story"] is None:
                for h, i in zip(hits, stories([h["text"] for h in hits], [h["parent"] for h in hits]), strict=True):
                    h["story"] = hits[i]["id"]
            for place, h in enumerate(pick(hits, r["take"], costs), 1):
                rows.append((r["request_id"], h["id"], h["kind"], h["score"], h["story"], place))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        kinds = [batch.schema.field("request_id").type, pa.string(), pa.string(), pa.float32(), pa.string(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, kinds, strict=True)], names=["request_id", "id", "kind", "score", "story", "place"])
