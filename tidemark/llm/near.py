"""Problem 3: near-duplicate texts within a block (a service).

Method: a byte-position inverted index with count filtering, in three steps.

1. Candidates. Every distinct word set gets ``GROUPS * GROUP_BYTES`` bytes, one per
   position: the low byte of the smallest hash under the position's own hash function.
   Two sets share such a byte with the probability of their Jaccard similarity, which is
   0.64 or more at a cosine of 0.8. A posting of one byte would hold 1/256 of all rows, so
   a posting is a run of ``GROUP_BYTES`` positions. This step is the only one that can lose
   a pair: with a probability of 0.04 % at a cosine of 0.8 between sets of one size (at most
   0.2 % between any), 0.0001 % at 0.85 (see the README for the exact index that was tried).
2. Count filter. Every set also gets bytes to tally, each the sum of the hashes of the
   words that fall to its position. Sets that differ in d words share all but d of them,
   and d is bounded by the threshold and the sizes; so a pair is dropped only if its tally
   of shared bytes is below the minimum that is guaranteed to every similar pair. The
   number of positions grows with the set, so the minimum is above 0 for every size.
3. Verification on the full word sets, as 32-bit hashes: two different words of a pair are
   taken for one with a probability of 2e-10 per pair of words. Equal sets are recognised by
   64 bits.

Postings travel packed (10 bytes each, one binary value per batch and target), about 560
bytes a document. Equal word sets are one class: they are posted once per batch, merged by
class, and expanded only in the final result. Postings are spread by the hash of (block,
run, bytes); no task ever holds a block, and a posting list of more than ``LIST_PART`` sets
is cut into parts that meet in tasks of their own.

Defined results: rows with null id, null or empty block, or a text without words are
no part of any pair; a document id with several texts is similar by any of them;
identical word sets have similarity 1; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import removed, written

GROUPS, GROUP_BYTES = 56, 5
#: Positions of the bytes that are tallied per pair, at least.
COUNTED = 64
#: Postings per reduce task; sets of a posting list that meet in one task.
TASK_POSTINGS, LIST_PART = 1_000_000, 2048
_RNG = np.random.default_rng(20240601)
_MUL = _RNG.integers(1, 2**31, GROUPS * GROUP_BYTES, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, GROUPS * GROUP_BYTES, dtype=np.int64).astype(np.uint32)
_MASK48 = np.uint64(2**48 - 1)


def block_of(service):
    """Lower case, letters and digits only; null if nothing remains."""
    return F.nullif(F.regexp_replace(F.lower(service), r"[^\p{L}\p{N}]", ""), F.lit(""))


class Words:
    """Texts of a batch -> sorted distinct 32-bit word hashes per text, concatenated."""

    def __init__(self, limit: int = 400_000) -> None:
        self.cache: dict[str, int] = {}
        self.limit = limit

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        cache, out, sizes = self.cache, [], np.zeros(len(texts), np.int64)
        if len(cache) > self.limit:
            cache.clear()
        for i, text in enumerate(texts):
            words = set((text or "").lower().split())
            sizes[i] = len(words)
            for w in words:
                h = cache.get(w)
                if h is None:
                    h = cache[w] = xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass"))
                out.append(h)
        flat = np.array(out, np.uint64) | (np.repeat(np.arange(len(texts), dtype=np.uint64), sizes) << np.uint64(32))
        flat.sort()
        return (flat & np.uint64(0xFFFFFFFF)).astype(np.uint32), sizes


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def classes(flat: np.ndarray, sizes: np.ndarray, blocks: list[str]) -> tuple[np.ndarray, list[bytes]]:
    """A 64-bit class per (block, word set) and the packed word sets."""
    ends = np.cumsum(sizes)
    packed = [flat[e - s : e].tobytes() for e, s in zip(ends, sizes, strict=True)]
    ids = [xxhash.xxh3_64_intdigest(p, seed=xxhash.xxh32_intdigest(b.encode("utf-8", "surrogatepass"))) for p, b in zip(packed, blocks, strict=True)]
    return np.array(ids, np.uint64), packed


def signature(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positional bytes, one row per text; every text must have words."""
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), len(_MUL)), np.uint8)
    step = max(1, 2_000_000 // max(1, len(flat)))
    for k in range(0, len(_MUL), step):
        h = flat[None, :] * _MUL[k : k + step, None] + _ADD[k : k + step, None]
        out[:, k : k + step] = np.minimum.reduceat(h, starts, axis=1).T & 0xFF
    return out


def postings(sig: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """A 64-bit key per text and run of positional bytes, mixed with the block."""
    runs = sig.reshape(len(sig), GROUPS, GROUP_BYTES).astype(np.uint64)
    value = np.zeros(runs.shape[:2], np.uint64)
    for i in range(GROUP_BYTES):
        value = (value << np.uint64(8)) | runs[:, :, i]
    return _mix(value ^ _mix(blocks[:, None] + np.arange(GROUPS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def positions(sizes: np.ndarray) -> np.ndarray:
    """How many bytes a set of each size has to tally: a power of two, ``COUNTED`` at least,
    and more than the words in which two similar sets of about this size may differ."""
    return np.maximum(COUNTED, 2 ** np.ceil(np.log2(np.maximum(1.0, 0.6 * sizes) - 1e-9)).astype(np.int64))


def counted_bytes(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The bytes to tally: a word changes the one byte of its position. The bytes of half as
    many positions are the sums of both halves."""
    many = positions(sizes)
    start = np.cumsum(many) - many
    mixed = _mix(flat.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    cell = np.repeat(start, sizes) + (mixed & np.repeat(many - 1, sizes).astype(np.uint64)).astype(np.int64)
    total = np.bincount(cell, weights=((mixed >> np.uint64(32)) & np.uint64(0xFF)).astype(np.float64), minlength=int(many.sum()))
    raw = (total.astype(np.int64) & 0xFF).astype(np.uint8).tobytes()
    return [raw[a : a + m] for a, m in zip(start.tolist(), many.tolist(), strict=True)]


def tallied(left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How many positional bytes every pair shares, and of how many positions."""
    many = np.array([min(len(x), len(y)) for x, y in zip(left, right, strict=True)], np.int64)
    equal = np.zeros(len(left), np.int64)
    fold = lambda raw, size: raw if len(raw) == size else np.frombuffer(raw, np.uint8).reshape(-1, size).sum(0, dtype=np.uint8).tobytes()
    for size in np.unique(many).tolist():
        here = np.flatnonzero(many == size)
        x, y = (np.frombuffer(b"".join([fold(side[i], size) for i in here]), np.uint8).reshape(-1, size) for side in (left, right))
        equal[here] = (x == y).sum(1)
    return equal, many


def least_tally(na: np.ndarray, nb: np.ndarray, many: np.ndarray, threshold: float) -> np.ndarray:
    """The shared bytes of ``many`` positions guaranteed to sets of these sizes at or above the threshold."""
    shared = np.ceil(threshold * np.sqrt((na * nb).astype(np.float64)) - 1e-9)
    return many - (na + nb - 2 * shared)


def _pack(keys: np.ndarray, cls: np.ndarray) -> np.ndarray:
    raw = np.empty((len(keys), 10), np.uint8)
    raw[:, :4] = keys.astype("<u4").view(np.uint8).reshape(-1, 4)
    raw[:, 4:] = cls.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return raw


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 10)
    cls = np.zeros((len(raw), 8), np.uint8)
    cls[:, :6] = raw[:, 4:]
    return np.ascontiguousarray(raw[:, :4]).view("<u4").ravel(), cls.view("<u8").ravel()


def _lists(key: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and class of every posting, in order and without repeats."""
    order = np.lexsort((cls, key))
    key, cls = key[order], cls[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    return key[new], cls[new]


def _pairs(key: np.ndarray, cls: np.ndarray, limit: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of different classes with an equal key, smaller class first."""
    key, cls = _lists(key, cls)
    end = np.searchsorted(key, key, side="right")
    here = np.flatnonzero(end - np.arange(len(key)) > 1)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, step = 0, 1
    while len(here):
        held.append((cls[here], cls[here + step]))
        size += len(here)
        step += 1
        here = here[here + step < end[here]]
        if size >= limit or not len(here):
            yield _unique(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [], 0


def _unique(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _long(key: np.ndarray, cls: np.ndarray, part: int) -> Iterator[tuple[bytes, bytes]]:
    """Two parts each of every list of more than ``part`` classes, in all combinations."""
    cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    for x in np.flatnonzero(np.diff(cut) > part):
        parts = [cls[at : min(at + part, cut[x + 1])].tobytes() for at in range(cut[x], cut[x + 1], part)]
        yield from ((p, q) for i, p in enumerate(parts) for q in parts[i:])


def _crossed(left: bytes, right: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of two parts of a list (or of one part with itself)."""
    x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    for at in range(0, len(x), 128):
        a, b = (v.ravel() for v in np.meshgrid(x[at : at + 128], y, indexing="ij"))
        keep = a < b if left == right else a != b
        yield np.minimum(a, b)[keep], np.maximum(a, b)[keep]


def _clean(df: DataFrame, key: str, block: str, text: str) -> DataFrame:
    out = df.select(F.col(key).cast("string").alias("id"), F.col(block).alias("block"), F.col(text).alias("text"))
    return out.where("id is not null and block is not null and block <> '' and text is not null and trim(text) <> ''")


def _members(docs: DataFrame, with_words: bool) -> DataFrame:
    """``cls`` (48 bits), ``full`` (64 bits) and the id or the packed words of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            flat, sizes = words(batch.column(2).to_pylist())
            cls, packed = classes(flat, sizes, batch.column(1).to_pylist())
            keep = np.flatnonzero(sizes)
            if with_words:
                _, first = np.unique(cls, return_index=True)
                keep = first[sizes[first] > 0]
                third = pa.array([packed[i] for i in keep], type=pa.binary())
            else:
                third = batch.column(0).take(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [pa.array((cls[keep] & _MASK48).astype(np.int64)), pa.array(cls[keep].view(np.int64)), third],
                names=["cls", "full", "words" if with_words else "id"],
            )

    return docs.mapInArrow(run, "cls bigint, full bigint, " + ("words binary" if with_words else "id string"))


def similar_classes(df: DataFrame, key: str, block: str, text: str, threshold: float = 0.8, part: int = LIST_PART) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``: pairs of word-set classes (``full_a``, ``full_b``, ``shared``,
    ``similarity``) at or above the threshold, and the ``id`` s of every class (``full``)."""
    docs = _clean(df, key, block, text)
    targets = max(8, -(-df.count() * GROUPS // TASK_POSTINGS))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        seeds: dict[str, int] = {}
        for batch in batches:
            blocks = batch.column(1).to_pylist()
            flat, sizes = words(batch.column(2).to_pylist())
            cls, _ = classes(flat, sizes, blocks)
            _, first = np.unique(cls, return_index=True)
            first = np.sort(first[sizes[first] > 0])
            chosen = np.zeros(len(sizes), bool)
            chosen[first] = True
            flat, sizes = flat[np.repeat(chosen, sizes)], sizes[first]
            if not len(first):
                continue
            for b in set(blocks) - seeds.keys():
                seeds[b] = xxhash.xxh3_64_intdigest(b.encode("utf-8", "surrogatepass"))
            keys = postings(signature(flat, sizes), np.array([seeds[blocks[i]] for i in first], np.uint64))
            who = np.repeat(cls[first], GROUPS)
            target = ((keys >> np.uint64(32)) % np.uint64(targets)).astype(np.int64).ravel()
            order = np.argsort(target, kind="stable")
            raw = _pack((keys.ravel() & np.uint64(0xFFFFFFFF))[order], who[order])
            cut = np.searchsorted(target[order], np.arange(targets + 1))
            there = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array(there.astype(np.int32)), pa.array([raw[cut[t] : cut[t + 1]].tobytes() for t in there], type=pa.binary())], names=["target", "blob"]
            )

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "left", "right"]

        def flush(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            key, cls = _lists(*_unpack(blobs))
            size = np.searchsorted(key, key, side="right") - np.searchsorted(key, key)
            # A long list is no task's own: its parts meet in tasks of their own.
            for left, right in _long(key, cls, part):
                yield pa.RecordBatch.from_arrays([pa.array([None], type=pa.int64())] * 2 + [pa.array([x], type=pa.binary()) for x in (left, right)], names=names)
            short = size <= part
            for a, b in _pairs(key[short], cls[short]):
                none = pa.nulls(len(a), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), none, none], names=names)

        now, blobs = None, []
        for batch in batches:
            for target, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if target != now and blobs:
                    yield from flush(blobs)
                    blobs = []
                now = target
                blobs.append(blob)
        if blobs:
            yield from flush(blobs)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = batch.filter(pc.is_valid(batch.column(0)))
            yield plain.select(["a", "b"])
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                for a, b in _crossed(left, right) if left is not None else ():
                    yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for column in (batch.column(2), batch.column(3)):
                blobs = column.to_pylist()
                size = np.array([len(x) // 4 for x in blobs], np.int64)
                sides.append((size, np.frombuffer(b"".join(blobs), np.uint32).astype(np.uint64) | (np.repeat(np.arange(len(blobs), dtype=np.uint64), size) << np.uint64(32))))
            (na, wa), (nb, wb) = sides
            both = np.sort(np.concatenate([wa, wb]))
            hit = both[1:][both[1:] == both[:-1]] >> np.uint64(32)
            shared = np.bincount(hit.astype(np.int64), minlength=len(na))
            similarity = shared / np.sqrt((na * nb).astype(np.float64))
            keep = pa.array(similarity >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared), pa.array(similarity)], names=["full_a", "full_b", "shared", "similarity"]).filter(keep)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            size = np.array([len(x) // 4 for x in blobs], np.int64)
            rows = counted_bytes(np.frombuffer(b"".join(blobs), np.uint32), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int32)), pa.array(rows, type=pa.binary())], names=["cls", "n", "counted"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy().astype(np.int64) for i in (2, 4))
            equal, many = tallied(batch.column(3).to_pylist(), batch.column(5).to_pylist())
            keep = equal >= least_tally(na, nb, many, threshold)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    # ``target`` is the number of a task already; hashing it again would fill some twice.
    blobs = docs.mapInArrow(post, "target int, blob binary").repartitionById(targets, "target").sortWithinPartitions("target")
    lists = blobs.mapInArrow(tally, "a bigint, b bigint, left binary, right binary").repartition("a", "b", "left", "right")
    # Placed by ``a`` before repeats are dropped, which serves the next join, too.
    found = lists.mapInArrow(spread, "a bigint, b bigint").repartition("a").distinct()
    # Placed by ``cls`` once, which serves the merging, the sketches and both joins. The
    # filter is the one that the joins infer; with it all of them share one exchange.
    sets = _members(docs, True).where("cls is not null").repartition("cls").groupBy("cls", "full").agg(F.first("words").alias("words"))
    counted = sets.select("cls", "words").mapInArrow(sketch, "cls bigint, n int, counted binary")
    near = found.join(counted.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("counted").alias("ca")), "a").join(
        counted.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("counted").alias("cb")), "b"
    )
    kept = near.select("a", "b", "na", "ca", "nb", "cb").mapInArrow(count, "a bigint, b bigint").distinct()
    left = sets.select(F.col("cls").alias("a"), F.col("full").alias("full_a"), F.col("words").alias("words_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("full").alias("full_b"), F.col("words").alias("words_b"))
    both = kept.join(left, "a").join(right, "b").select("full_a", "full_b", "words_a", "words_b")
    pairs = both.mapInArrow(verify, "full_a bigint, full_b bigint, shared bigint, similarity double")
    return pairs, _members(docs, False).select("full", "id").distinct()


def similar_pairs(df: DataFrame, key: str, block: str, text: str, threshold: float = 0.8) -> DataFrame:
    """``id_a`` < ``id_b``: all pairs of different ids, copies expanded."""
    pairs, members = similar_classes(df, key, block, text, threshold)
    a = members.select(F.col("full").alias("full_a"), F.col("id").alias("x"))
    b = members.select(F.col("full").alias("full_b"), F.col("id").alias("y"))
    # A class and itself: copies. Their join and that of the found pairs share one shape.
    links = pairs.select("full_a", "full_b")
    crossed = links.join(a, "full_a").join(b, "full_b").select("x", "y")
    copies = a.join(b, a["full_a"] == b["full_b"]).where("x < y").select("x", "y")
    both = crossed.unionAll(copies).where("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def groups(df: DataFrame, key: str, block: str, text: str, threshold: float = 0.8, rounds: int = 500) -> DataFrame:
    """One row per document: ``id``, ``group_id`` (the smallest id of its connected
    component) and ``n_links`` (similar classes other than its own plus its copies)."""
    pairs, members = similar_classes(df, key, block, text, threshold)
    pairs = written(pairs, "near-pairs")
    members = written(members, "near-members")
    edges = pairs.select(F.col("full_a").alias("u"), F.col("full_b").alias("v"))
    edges = edges.unionAll(edges.select("v", "u"))
    # A document with several texts links its classes.
    several = members.groupBy("id").agg(F.min("full").alias("u"), F.max("full").alias("v")).where("u <> v").select("id")
    own = members.join(several, "id").groupBy("id").agg(F.min("full").alias("m")).join(members, "id").where("m <> full")
    own = own.select(F.col("m").alias("u"), F.col("full").alias("v"))
    edges = written(edges.unionAll(own).unionAll(own.select("v", "u")).distinct(), "near-edges")
    labels = last = written(edges.select("u").distinct().select("u", F.col("u").alias("label")), "near-labels")
    for _ in range(rounds):
        lower = edges.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        best = labels.join(lower, "u").select("u", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        # Pointer jumping: take the label of one's label.
        jump = best.select(F.col("u").alias("label"), F.col("label").alias("far"))
        after = written(best.join(jump, "label").select("u", F.least("label", "far").alias("label"), "was"), "near-labels")
        removed(last)
        last, labels = after, after.select("u", "label")
        if after.where("label <> was").isEmpty():
            break
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    degree = pairs.select(F.col("full_a").alias("full")).unionAll(pairs.select("full_b")).groupBy("full").agg(F.count("*").alias("n"))
    sizes = members.groupBy("full").agg(F.count("*").alias("copies"))
    told = (
        members.join(labels.withColumnRenamed("u", "full"), "full", "left")
        .join(degree, "full", "left")
        .join(sizes, "full")
        .select("id", F.coalesce("label", "full").alias("label"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    told = told.groupBy("id").agg(F.min("label").alias("label"), F.sum("n_links").alias("n_links"))
    names = told.groupBy("label").agg(F.min("id").alias("group_id"), F.count("*").alias("group_size"))
    return told.join(names, "label").select("id", "group_id", "group_size", "n_links")
