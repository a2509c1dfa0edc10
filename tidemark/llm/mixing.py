"""Problem 8: mixing sources to target weights.

Method: hierarchical budgeting. Every document is measured in tokens of a public
tokenizer. The documents of a mix form a tree (domain, language, source); weights come
from the targets of the sources, divided by the sizes of their languages. The total is
filled top-down: a node gets its weight, at most what its leaves may give with the allowed
repeats, and what it can't give goes to its siblings (sources of the language, then
languages of the domain) before it goes to other domains. A leaf then yields whole epochs
and the token prefix of one more, in an order given by a seeded hash.

The prefix is found without sorting a leaf in one task: token sums per hash bucket give
the bucket where the budget ends, and only that bucket is ordered. Nothing is collected;
the leaves are broadcast if they are at most ``MAX_LEAVES`` and joined otherwise.

Defined results: documents without id, source or text belong to no mix; empty texts have
size 0 and are never chosen; a null language is a leaf of its own; a source without
documents can't give anything; repeated targets of a source in a mix count once (the
largest); a null share counts as 0 and a null or negative repeat limit as 0. The last
document of a prefix is taken if more than half of it fits.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The vocabulary file on the driver, unless the session sets ``spark.tidemark.vocabulary``.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that tokenizer splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Leaves that are broadcast at most.
MAX_LEAVES = 200_000
BUCKETS = 4096


@cache
def _encoding(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """Add ``n_tokens`` (null for null texts) and drop ``text``. The vocabulary file is read
    on the driver (under 2 MB) and broadcast."""
    with open(vocabulary or df.sparkSession.conf.get("spark.tidemark.vocabulary", VOCABULARY), "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())
    others = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(raw.value, pattern)
        for batch in batches:
            counts = [None if t is None else len(encoding.encode_ordinary(t)) for t in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(counts, type=pa.int64())], names=[*others, "n_tokens"])

    source = df.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, ddl + ", n_tokens bigint")


def _fill(amount: float, weights: list[float], caps: list[float]) -> list[float]:
    """Share ``amount`` by weight under the caps; what one can't take the others share."""
    got = [0.0] * len(weights)
    live = [i for i in range(len(weights)) if weights[i] > 0 and caps[i] > 0]
    left = min(amount, sum(caps[i] for i in live))
    while live and left > 1e-9:
        total = sum(weights[i] for i in live)
        full = [i for i in live if caps[i] - got[i] <= left * weights[i] / total + 1e-12]
        if not full:
            for i in live:
                got[i] += left * weights[i] / total
            break
        for i in full:
            left -= caps[i] - got[i]
            got[i] = caps[i]
        live = [i for i in live if i not in set(full)]
    return got


#: The levels of the tree above its leaves, a source each.
LEVELS = ["domain", "lang"]


def budget(leaves: list[dict], levels: list[str], total: float) -> list[float]:
    """Tokens per leaf (``weight``, ``cap`` and its name on every level)."""
    out = [0.0] * len(leaves)

    def down(members: list[int], depth: int, amount: float) -> None:
        if depth == len(levels):
            for i, got in zip(members, _fill(amount, [leaves[i]["weight"] for i in members], [leaves[i]["cap"] for i in members]), strict=True):
                out[i] = got
            return
        parts: dict = defaultdict(list)
        for i in members:
            parts[leaves[i][levels[depth]]].append(i)
        parts = [parts[k] for k in sorted(parts, key=str)]
        sums = lambda what: [sum(leaves[i][what] for i in p if leaves[i]["weight"] > 0) for p in parts]
        for part, got in zip(parts, _fill(amount, sums("weight"), sums("cap")), strict=True):
            down(part, depth + 1, got)

    down(list(range(len(leaves))), 0, total)
    return out


def plan(sized: DataFrame, targets: DataFrame, domains: dict[str, str]) -> DataFrame:
    """The budget of every mix, a row per leaf: ``mix_id``, ``domain``, ``lang``, ``source``,
    its ``size``, the tokens ``wanted`` by its weight, ``tokens`` it gets, the source's
    ``target_share`` and what the leaf stays below its own weight (``unmet``). ``sized`` has
    ``source``, ``lang`` and ``n_tokens`` per document. A task holds the leaves of one mix."""
    sums = sized.groupBy("source", "lang").agg(F.sum("n_tokens").cast("double").alias("size")).where("size > 0")
    wanted = targets.where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(
        F.coalesce(F.max("target_share"), F.lit(0.0)).alias("share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("repeats"), F.coalesce(F.max("total_ratio"), F.lit(0.0)).alias("ratio")
    )
    # A source without documents is a leaf that can't give anything.
    leaves = wanted.join(sums, "source", "left").select("mix_id", "source", "lang", "share", "repeats", "ratio", F.coalesce("size", F.lit(0.0)).alias("size"))

    def fill(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["source"], str(r["lang"])))
        size: dict = defaultdict(float)
        for r in rows:
            size[r["source"]] += r["size"]
        total = max(r["ratio"] for r in rows) * sum(size.values())
        for r in rows:
            part = r["size"] / size[r["source"]] if r["size"] else 1.0
            r |= {"domain": domains.get(r["source"], "other"), "weight": r["share"] * part, "cap": r["repeats"] * r["size"], "target_share": r["share"], "wanted": r["share"] * part * total}
        for r, got in zip(rows, budget(rows, LEVELS, total), strict=True):
            # A leaf gets its own weight first, so it stays below only if it can't give more.
            r |= {"tokens": got, "unmet": r["wanted"] - got if r["wanted"] - got > 1e-9 * max(1.0, r["wanted"]) else 0.0}
        return pa.Table.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema=schema)

    text, number = pa.string(), pa.float64()
    schema = pa.schema([("mix_id", pa.int32()), ("domain", text), ("lang", text), ("source", text), ("target_share", number), ("size", number), ("wanted", number), ("tokens", number), ("unmet", number)])
    ddl = "mix_id int, domain string, lang string, source string, target_share double, size double, wanted double, tokens double, unmet double"
    return leaves.withColumn("mix_id", F.col("mix_id").cast("int")).groupBy("mix_id").applyInArrow(fill, ddl)


def choose(sized: DataFrame, parts: DataFrame, key: str, seed: int = 11) -> DataFrame:
    """``mix_id``, ``key``, ``source``, ``n_tokens``, ``repeats``: the documents of every mix.
    ``parts`` is the result of ``plan``, written."""
    epochs = F.floor(F.col("tokens") / F.col("size"))
    table = parts.where("size > 0").select("mix_id", "source", "lang", epochs.alias("epochs"), (F.col("tokens") - epochs * F.col("size")).alias("rest"))
    few = table.limit(MAX_LEAVES + 1).count() <= MAX_LEAVES
    if few:
        table = F.broadcast(table)
    same = lambda a, b: (a["source"] == b["source"]) & a["lang"].eqNullSafe(b["lang"])
    docs = sized.where("n_tokens > 0").select(key, "source", "lang", "n_tokens")
    placed = docs.join(table, same(docs, table)).select("mix_id", docs[key], docs["source"], docs["lang"], "n_tokens", "epochs", "rest")
    order = F.xxhash64(F.lit(seed), "mix_id", "epochs", F.col(key).cast("string"))
    placed = placed.withColumns({"h": order, "bucket": F.pmod(F.shiftrightunsigned(order, 32), F.lit(BUCKETS))})
    leaf = ["mix_id", "source", "lang"]
    sums = placed.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("s"), F.first("rest").alias("rest"))
    before = F.sum("s").over(W.partitionBy(*leaf).orderBy("bucket")) - F.col("s")
    edges = sums.withColumn("before", before).where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("s") > F.col("rest")))
    edges = edges.select(*leaf, F.col("bucket").alias("edge"), "before")
    if few:  # a row per leaf at most
        edges = F.broadcast(edges)
    x = placed.alias("x").join(
        edges.alias("e"), F.expr("x.mix_id = e.mix_id and x.source = e.source and x.lang <=> e.lang"), "left"
    ).select("x.*", "edge", "before")
    inside = x.where("bucket <> edge or edge is null").withColumn("more", F.when(F.col("bucket") < F.col("edge"), 1).otherwise(F.when(F.col("edge").isNull() & (F.col("rest") > 0), 1).otherwise(0)))
    run = F.col("before") + F.sum("n_tokens").over(W.partitionBy(*leaf).orderBy("h", key).rowsBetween(W.unboundedPreceding, 0))
    last = x.where("bucket = edge").withColumn("more", (run - F.col("n_tokens") / 2 < F.col("rest")).cast("int"))
    both = inside.unionByName(last).withColumn("repeats", (F.col("epochs") + F.col("more")).cast("bigint"))
    return both.where("repeats > 0").select("mix_id", key, "source", "n_tokens", "repeats")
