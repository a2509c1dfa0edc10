"""One incremental load by a time cursor: fetch a window, merge, then move the cursor.

The cursor is written last, so a failed run is repeated over the same window, and merging
the same documents again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators.store import VersionedStore, put, window
from tidemark.session import removed, written
from tidemark.sources import observability as obs
from tidemark.streaming.index import Provider, merge


class Cursor:
    """An instant in a small file, replaced by one rename."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def read(self) -> str | None:
        if not self._fs.exists(self._Path(self.path)):
            return None
        return self.spark.read.text(self.path, wholetext=True).first()[0].strip()

    def write(self, instant: str) -> None:
        put(self.spark, self.path, instant, over=True)


def iso(seconds: int) -> str:
    return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def documents(raw: DataFrame, until: str) -> DataFrame:
    """All documents of raw responses (``kind``, ``payload``), monitors first."""
    of = lambda kind: raw.where(F.col("kind") == kind)
    return obs.union(
        obs.monitors(of("monitor")), obs.dashboards(of("dashboard")), obs.slos(of("slo")), obs.metrics(of("metrics"), until), obs.incidents(of("incident")), obs.logs(of("logs"))
    )


def load(spark: SparkSession, root: str, fetch: Callable[[str, str], DataFrame], now: int, settings: Settings | None = None, provider: Provider | None = None) -> tuple[str, str]:
    """Fetch the window from the cursor to ``now`` with ``fetch(from, to)``, merge its documents
    into the store at ``root`` and move the cursor. Returns the window."""
    settings = settings or Settings()
    cursor, store = Cursor(spark, f"{root}/cursor"), VersionedStore(spark, f"{root}/points", buckets=settings.store_buckets)
    span = spark.range(1).select(window(F.lit(cursor.read()).cast("string"), F.lit(now).cast("long"), settings.lookback_minutes).alias("w")).first()["w"]
    start, end = iso(span["from_s"]), iso(span["to_s"])
    # Fetched once: every reader of the responses reads what has landed.
    raw = written(fetch(start, end), "responses")
    merge(store, documents(raw, end).withColumn("version", F.lit(now).cast("long")), settings, "version", provider)
    removed(raw)
    cursor.write(end)
    return start, end
