"""Problem 5: the most similar vectors of every vector.

Method: balanced posting lists. Centroids are fitted on a bounded sample by a two-level
k-means; one that draws far more of the sample than the others is divided again, so lists
are about equally long. The centroids form an in-memory graph, each linked to its ``LINKS``
nearest; a search enters at the best centroid of the best pivot (first level), walks to the
best linked one until none is better, and looks at the lists linked there. A vector is
replicated to every list whose distance is within a ratio of its nearest one, up to a fixed
number. Queries prune the lists to search by the same distance ratio. The number of lists
grows with the rows (``LIST_SIZE`` each) up to ``MAX_LISTS``; lists that the sample shows to
be longer than ``MAX_LIST`` are divided, and each task compares one part of the members with
one part of the queries.

The vectors travel packed as 16-bit integers (a cosine is off by about 1e-5). Equal
vectors are one class: its smallest ids stand for it as neighbours, and all its ids get
their own neighbours. Only the sample (``SAMPLE`` vectors at most) reaches the driver.

Defined results: null, empty and all-zero vectors, and those of another length than most,
with a missing or not finite number, have no neighbours and are none; lengths of vectors
don't matter; ties go to the smaller id; a point sent again with the same vector counts
once, with other vectors it is near by any of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bounds of what is fitted and broadcast: vectors in the sample, lists in the index.
SAMPLE, MAX_LISTS = 524_288, 16_384
#: Vectors of the sample per list.
PER_LIST = 32
LIST_SIZE, MAX_LIST = 1024, 20_000
#: Links of every centroid in the graph.
LINKS = 96
_SCALE = 32767.0


def usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and unit vectors of the usable rows of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    rows = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(column.take(pa.array(rows)))
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) if dim else np.zeros((0, 0))
    norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], x[good] / norm[good, None]


def quantised(x: np.ndarray) -> np.ndarray:
    return np.rint(x * _SCALE).astype(np.int16)


def class_of(q: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(r) for r in q], np.uint64).view(np.int64)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centre = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        label = (x @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, label, x)
        norm = np.linalg.norm(total, axis=1)
        empty = norm == 0
        total[empty] = x[rng.integers(0, len(x), int(empty.sum()))]
        centre = total / np.maximum(np.linalg.norm(total, axis=1), 1e-12)[:, None]
    return centre, (x @ centre.T).argmax(1)


@dataclass
class Lists:
    """The fitted index: pivots as entries, the centroids by pivot and their graph."""

    pivots: np.ndarray
    centroids: np.ndarray
    bounds: np.ndarray  # the centroids of pivot p are bounds[p]:bounds[p + 1]
    links: np.ndarray  # the centroids nearest to each centroid, itself among them
    parts: np.ndarray  # into how many parts each list is divided

    def walk(self, x: np.ndarray) -> np.ndarray:
        """The centroid where a walk over the graph ends: from the best one of the best
        pivot to the best linked one, until none is better."""
        at, score = np.zeros(len(x), np.int64), np.full(len(x), -2.0, np.float32)

        def step(place: np.ndarray, live: np.ndarray, look) -> np.ndarray:
            moved = [live[:0]]
            for p, here in _groups(place[live]):
                near, some = look(p), live[here]
                found = x[some] @ self.centroids[near].T
                best = found.argmax(1)
                value = found[np.arange(len(some)), best]
                better = value > score[some] + 1e-6
                at[some[better]], score[some[better]] = near[best[better]], value[better]
                moved.append(some[better])
            return np.concatenate(moved)

        live = step((x @ self.pivots.T).argmax(1), np.arange(len(x)), lambda p: np.arange(self.bounds[p], self.bounds[p + 1]))
        while len(live):
            live = step(at.copy(), live, lambda c: self.links[c])
        return at

    def nearest(self, x: np.ndarray, most: int, ratio: float) -> list[np.ndarray]:
        """For every vector the lists within ``ratio`` of its nearest list's distance."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(x)
        if not len(x):
            return out
        at = self.walk(x)
        for c, here in _groups(at):
            lists = self.links[c]
            for start in range(0, len(here), 4096):
                some = here[start : start + 4096]
                distance = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x[some] @ self.centroids[lists].T)))
                m = min(most, len(lists))
                near = np.argpartition(distance, m - 1, axis=1)[:, :m] if m < len(lists) else np.broadcast_to(np.arange(len(lists)), distance.shape)
                d = np.take_along_axis(distance, near, 1)
                keep = d <= d.min(1, keepdims=True) * ratio + 1e-9
                for i, row in enumerate(some):
                    out[row] = lists[near[i][keep[i]]]
        return out


def _groups(label: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each label with its places."""
    order = np.argsort(label, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], label[order][1:] != label[order][:-1], [True]])) if len(label) else np.zeros(1, np.int64)
    return [(int(label[order[a]]), order[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _balanced(x: np.ndarray, k: int, size: float, rng: np.random.Generator) -> np.ndarray:
    """Centroids of ``x``: ``k`` at first; one with far more than ``size`` vectors is divided again."""
    centre, label = _kmeans(x, k, rng)
    done = []
    for c, here in _groups(label):
        more = int(round(len(here) / size))
        if len(here) > 1.5 * size and more > 1 and len(here) < len(x):
            done.append(_balanced(x[here], more, size, rng))
        else:
            done.append(centre[c : c + 1])
    return np.concatenate(done)


def _nearest_rows(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((len(x), k), np.int64)
    for at in range(0, len(x), 2048):
        score = x[at : at + 2048] @ x.T
        out[at : at + 2048] = np.argpartition(-score, k - 1, axis=1)[:, :k] if k < len(x) else np.arange(len(x))
    return out


def fit(sample: np.ndarray, rows: int, seed: int = 7) -> Lists:
    """Fit the lists for ``rows`` vectors on the sample."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float32)
    lists = int(max(1, min(MAX_LISTS, rows // LIST_SIZE, len(x) // 4)))
    first = int(max(1, round(lists**0.5)))
    pivots, label = _kmeans(x, first, rng)
    size = len(x) / lists
    parts, bounds = [], [0]
    for p in range(first):
        own = x[label == p]
        k = max(1, round(len(own) / size))
        parts.append(_balanced(own, min(k, len(own)), size, rng) if len(own) else pivots[p : p + 1])
        bounds.append(bounds[-1] + len(parts[-1]))
    centroids = np.concatenate(parts)
    index = Lists(pivots, centroids, np.array(bounds), _nearest_rows(centroids, min(LINKS, len(centroids))), np.ones(bounds[-1], np.int64))
    load = np.bincount(index.walk(x), minlength=bounds[-1]) * (rows / len(x))
    index.parts = np.clip(np.ceil(load / MAX_LIST), 1, 4095).astype(np.int64)
    return index


def _sample(points: DataFrame, rows: int, share: str = "id") -> tuple[np.ndarray, int]:
    """Vectors chosen by the hash of their id, ``PER_LIST`` for every list of ``rows`` but some
    thousands at least and at most ``SAMPLE``, and the usual length."""
    most = min(SAMPLE, max(65_536, PER_LIST * (rows // LIST_SIZE)))
    limit = int(min(1.0, most / max(1, rows)) * 1_000_000_000) + 1
    some = points.where(F.pmod(F.xxhash64(share), F.lit(1_000_000_000)) < limit)
    lengths = some.where("size(vector) > 0").groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not lengths:
        return np.zeros((0, 0)), 0
    dim = lengths[0]["n"]
    column = some.where(F.size("vector") == dim).select("vector").limit(most + most // 8).toArrow()["vector"]
    return usable(column, dim)[1], dim


def nearest_classes(points: DataFrame, queries: DataFrame | None, k: int, min_score: float, copies: int, probes: int, ratio: float, probe_ratio: float) -> tuple[DataFrame, int]:
    """``q``, ``n``, ``score``: for every class of query vectors the ``k`` most similar other
    classes found in its lists. ``queries`` None: every point, searched in its own lists."""
    rows = points.count()
    sample, dim = _sample(points, rows)
    if not len(sample):
        return points.sparkSession.createDataFrame([], "q bigint, n bigint, score double"), 0
    index = points.sparkSession.sparkContext.broadcast(fit(sample, rows))
    targets = max(4, -(-rows * (copies if queries is None else copies + 1) // 100_000))
    width = 8 + 2 * dim

    def post(role: int, most: int, within: float):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists = index.value
            for batch in batches:
                _, x = usable(batch.column(0), dim)
                if not len(x):
                    continue
                q = quantised(x)
                cls = class_of(q)
                cls, once = np.unique(cls, return_index=True)
                q, x = q[once], x[once].astype(np.float32)
                near = lists.nearest(x, most, within)
                raw = np.concatenate([cls.view(np.uint8).reshape(-1, 8), np.ascontiguousarray(q).view(np.uint8).reshape(len(q), -1)], 1)
                which = np.repeat(np.arange(len(q)), [len(n) for n in near])
                where = np.concatenate(near) if near else np.zeros(0, np.int64)
                # A part of the members meets every part of the queries.
                parts = lists.parts[where] if len(where) else where
                mine = (cls[which].view(np.uint64) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64)
                keys: list[tuple[np.ndarray, np.ndarray, int]] = []
                for r in (0, 1):
                    if role in (r, 2):
                        rep = np.repeat(np.arange(len(which)), parts)
                        other = np.arange(len(rep)) - np.repeat(np.cumsum(parts) - parts, parts)
                        a, b = (mine[rep], other) if r == 0 else (other, mine[rep])
                        keys.append(((where[rep] << 24) | (a << 12) | b, which[rep], r))
                if role == 2 and (len(parts) == 0 or parts.max() == 1):
                    keys = [(where << 24, which, 2)]
                for key, who, r in keys:
                    order = np.argsort(key, kind="stable")
                    key, who = key[order], who[order]
                    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[cut[:-1]]), pa.array(np.full(len(cut) - 1, r, np.int32)), pa.array([raw[who[a:b]].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], type=pa.binary())],
                        names=["list", "role", "blob"],
                    )

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def load(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, width)
            cls = np.ascontiguousarray(raw[:, :8]).view(np.int64).ravel()
            cls, once = np.unique(cls, return_index=True)
            return cls, np.ascontiguousarray(raw[once, 8:]).view(np.int16).astype(np.float32) / np.float32(_SCALE)

        def flush(held: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
            mc, mx = load(held[0] + held[2])
            qc, qx = (mc, mx) if not held[1] else load(held[1] + held[2])
            if not len(mc) or not len(qc):
                return
            # The query itself may be a member or not; its own row fails the score below.
            m = min(k, len(mc))
            for at in range(0, len(qc), 1024):
                score = qx[at : at + 1024] @ mx.T
                score[qc[at : at + 1024, None] == mc[None, :]] = -2.0
                top = np.argpartition(-score, m - 1, axis=1)[:, :m] if m < len(mc) else np.broadcast_to(np.arange(len(mc)), score.shape)
                value = np.take_along_axis(score, top, 1)
                r, c = np.nonzero(value >= max(min_score, -1.5))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qc[at : at + 1024][r]), pa.array(mc[top[r, c]]), pa.array(value[r, c].astype(np.float64))], names=["q", "n", "score"]
                )

        now, held = None, {0: [], 1: [], 2: []}
        for batch in batches:
            for key, role, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != now and now is not None:
                    yield from flush(held)
                    held = {0: [], 1: [], 2: []}
                now = key
                held[role].append(blob)
        if now is not None:
            yield from flush(held)

    schema = "list bigint, role int, blob binary"
    if queries is None:
        posted = points.select("vector").mapInArrow(post(2, copies, ratio), schema)
    else:
        posted = points.select("vector").mapInArrow(post(0, copies, ratio), schema).unionAll(queries.select("vector").mapInArrow(post(1, probes, probe_ratio), schema))
    found = posted.repartition(targets, "list").sortWithinPartitions("list").mapInArrow(search, "q bigint, n bigint, score double")
    return found.groupBy("q", "n").agg(F.max("score").alias("score")), dim


def _classes(points: DataFrame, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = usable(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([pa.array(class_of(quantised(x))), batch.column(0).take(pa.array(rows))], names=["cls", "id"])

    return points.select("id", "vector").mapInArrow(run, "cls bigint, id string").distinct()


def neighbours(
    df: DataFrame, key: str, vector: str, k: int = 5, min_score: float = -1.0, copies: int = 4, ratio: float = 1.25,
    queries: DataFrame | None = None, probes: int = 24, probe_ratio: float = 1.4,
) -> DataFrame:
    """``id``, ``neighbour``, ``score``, ``place``: the ``k`` most similar other points of
    every point (or of the points in ``queries``) with a cosine of at least ``min_score``."""
    tidy = lambda d: d.select(F.col(key).cast("string").alias("id"), F.col(vector).alias("vector")).where("id is not null and size(vector) > 0")
    points = tidy(df)
    asked = None if queries is None else tidy(queries)
    edges, dim = nearest_classes(points, asked, k, min_score, copies, probes, ratio, probe_ratio)
    members = _classes(points, dim)
    smallest = members.withColumn("r", F.row_number().over(W.partitionBy("cls").orderBy("id"))).where(F.col("r") <= k + 1)
    first = smallest.where("r = 1").select(F.col("cls").alias("n"), F.col("id").alias("least"))
    best = edges.join(first, "n").withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "least"))).where(F.col("r") <= k)
    near = best.select("q", "n", "score").join(smallest.select(F.col("cls").alias("n"), "id"), "n").select("q", "id", "score")
    # A class is near itself, which matters where it has several ids.
    own = smallest.withColumn("m", F.count("*").over(W.partitionBy("cls"))).where("m > 1").select(F.col("cls").alias("q"), "id", F.lit(1.0).alias("score"))
    ranked = near.unionAll(own).withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("r") <= k + 1)
    askers = members if asked is None else _classes(asked, dim)
    out = ranked.select("q", F.col("id").alias("neighbour"), "score").join(askers.select(F.col("cls").alias("q"), "id"), "q").where("id <> neighbour")
    # A point with several vectors keeps the best score of each neighbour.
    out = out.groupBy("id", "neighbour").agg(F.max("score").alias("score"))
    out = out.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "neighbour")))
    return out.where(F.col("place") <= k).select("id", "neighbour", "score", "place")
