"""The vector store: payloads, latest-wins merges, batches and the load cursor."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payload key -> document column.
PAYLOAD = {
    "Title": "title", "Text": "text", "SourceUri": "source_uri", "Kind": "kind", "Timestamp": "timestamp",
    "Service": "service", "Environment": "environment", "Metadata": "metadata", "id": "id",
}


def payload() -> Column:
    """A document as the JSON that a search returns; metadata stays nested."""
    cells = [F.try_parse_json(F.coalesce("metadata", F.lit("{}"))).alias(k) if k == "Metadata" else F.col(c).alias(k) for k, c in PAYLOAD.items()]
    return F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})


def searchable(points: DataFrame) -> DataFrame:
    """The points of a store with the columns of their documents, read from the payloads, and
    the instant in ``seconds``."""
    from tidemark.functions.exprs import rfc3339_seconds

    cells = {c: F.get_json_object("payload", f"$.{k}") for k, c in PAYLOAD.items() if c != "id"}
    out = points.where("point_id is not null").select("id", "chunk_of", "vector", *[x.alias(c) for c, x in cells.items()])
    return out.withColumn("seconds", rfc3339_seconds(F.col("timestamp")))


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row per key by ``order``. Rows are compared through a fixed-size maximum,
    so a key with very many versions is merged map-side."""
    rest = [c for c in df.columns if c not in (key, *order)]
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("__last"))
    return best.select(key, "__last.*").select(*df.columns)


def without_stale_chunks(store: DataFrame, fresh: DataFrame, parent: str = "chunk_of") -> DataFrame:
    """The store with every parent that was indexed again replaced as a whole."""
    again = fresh.select(parent).distinct()
    return store.join(again, parent, "left_anti").unionByName(fresh)


def batches(df: DataFrame, size: int = 64, send: Callable[[list[dict]], None] | None = None) -> DataFrame:
    """``batch_id``, ``n``: the rows of every partition in batches of ``size``. ``send`` is
    called with the rows of every batch, as an upsert service receives them; a batch that
    can't be sent fails its task, which sends it again."""
    names = df.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for part in parts:
            if send is None:
                held += [{}] * part.num_rows
            else:
                held += [dict(zip(names, row.values(), strict=True)) for row in part.to_pylist()]
            full = len(held) // size
            for n in range(full if send else 0):
                send(held[n * size : (n + 1) * size])
            held = held[full * size :]
            yield pa.RecordBatch.from_arrays([pa.array([size] * full, type=pa.int64())], names=["n"])
        if held:
            if send is not None:
                send(held)
            yield pa.RecordBatch.from_arrays([pa.array([len(held)], type=pa.int64())], names=["n"])

    source = df if send is not None else df.select(F.lit(1).alias("one"))
    return source.mapInArrow(run, "n bigint").withColumn("batch_id", F.monotonically_increasing_id())


class VersionedStore:
    """A parquet store in buckets by the hash of the column ``by``. A new version replaces
    only the buckets that a merge touches; the others stay where they are. Readers follow a
    manifest and are never overwritten. The manifest comes last, by a rename that fails if
    another writer took its number, so a failed merge leaves no trace. The number of
    ``buckets`` is fixed by the first version; a bucket is what a merge rewrites at least."""

    def __init__(self, spark: SparkSession, root: str, by: str = "chunk_of", buckets: int = 32) -> None:
        self.spark, self.root, self.by, self.buckets = spark, root.rstrip("/"), by, buckets

    def versions(self) -> list[str]:
        path, fs = _file_system(self.spark, f"{self.root}/manifests")
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(path)) if n[:1].isdigit()) if fs.exists(path) else []

    def _manifest(self, names: list[str]) -> dict:
        if not names:
            return {"buckets": self.buckets, "data": {}}
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{names[-1]}", wholetext=True).first()[0])

    def read(self, only: DataFrame | None = None) -> DataFrame | None:
        """The rows now, or those of the buckets that the rows ``only`` fall to."""
        manifest = self._manifest(self.versions())
        wanted = None if only is None else self._touched(only, manifest)
        paths = [f"{self.root}/data/{d}/bucket={b}" for b, d in sorted(manifest["data"].items()) if wanted is None or int(b) in wanted]
        return self.spark.read.schema(manifest["schema"]).parquet(*paths) if paths else None

    def _touched(self, rows: DataFrame, manifest: dict) -> set[int]:
        return {r[0] for r in rows.select(self._bucket(manifest)).distinct().collect()}  # a number per bucket

    def _bucket(self, manifest: dict) -> Column:
        return F.pmod(F.xxhash64(F.col(self.by)), F.lit(manifest["buckets"])).cast("int").alias("bucket")

    def replace(self, df: DataFrame, only: DataFrame | None = None) -> None:
        """``df`` becomes the store, or the content of the buckets that ``only`` falls to."""
        names = self.versions()
        manifest = self._manifest(names)
        name = uuid.uuid4().hex
        gone = set(manifest["data"]) if only is None else {str(b) for b in self._touched(only, manifest)}
        # Rebalanced at run time: a large bucket is divided, small ones share a task.
        df.withColumn("bucket", self._bucket(manifest)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{name}")
        path, fs = _file_system(self.spark, f"{self.root}/data/{name}")
        new = {s.getPath().getName().partition("=")[2]: name for s in fs.listStatus(path) if s.getPath().getName().startswith("bucket=")}
        data = {b: d for b, d in manifest["data"].items() if b not in gone} | new
        text = json.dumps({"buckets": manifest["buckets"], "schema": _ddl(df), "data": data})
        number = int(names[-1]) + 1 if names else 0
        put(self.spark, f"{self.root}/manifests/{number:09d}", text, over=False)

    def upsert(self, fresh: DataFrame, key: str, *order: str) -> None:
        """Merge by ``key``; the later row by ``order`` stays. Merging again changes nothing."""
        old = self.read(fresh)
        self.replace(latest(fresh if old is None else old.unionByName(fresh), key, *order), fresh)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def put(spark: SparkSession, path: str, text: str, over: bool) -> None:
    """A small file under its name at once or not at all: written beside it and renamed.
    Without ``over`` an existing file is an error."""
    at, fs = _file_system(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    way = spark.sparkContext._gateway.new_array(rename, 1)
    way[0] = rename.valueOf("OVERWRITE" if over else "NONE")
    full = lambda p: fs.makeQualified(p)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(full(at).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(full(beside), full(at), way)


def window(cursor: Column, now: Column, lookback_minutes: int = 90) -> Column:
    """The span to load: from the cursor if it is a valid instant, else the lookback, to now."""
    from tidemark.functions.exprs import rfc3339_seconds

    start = F.coalesce(rfc3339_seconds(F.trim(cursor)), now - lookback_minutes * 60)
    return F.struct(start.alias("from_s"), now.alias("to_s"))
