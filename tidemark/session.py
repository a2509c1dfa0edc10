"""Session defaults and the shared folder that survives the loss of executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Session settings every query relies on; the caller's own settings win.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "tidemark", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests, the bench and the command line."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in {
        **DEFAULTS,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        **conf,
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Only a local session, whose
    executors are on one machine, may do without; it gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "tidemark-shared")
    return path.rstrip("/")


_WRITTEN: list[str] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back, so
    that a lost executor never forces the work before it to be repeated. The files are
    removed by ``removed`` or when the driver's process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    if not _WRITTEN:
        atexit.register(_remove_all, spark)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def removed(df: DataFrame) -> None:
    """Remove what ``written`` wrote; nothing may read it any more."""
    _remove(df.sparkSession, df._tidemark_path)
    _WRITTEN.remove(df._tidemark_path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _remove_all(spark: SparkSession) -> None:
    try:
        for path in _WRITTEN:
            _remove(spark, path)
    except Exception:  # the session has ended; the folder's owner cleans up
        pass
