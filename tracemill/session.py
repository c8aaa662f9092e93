"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(master: str | None = None, name: str = "tracemill", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str | None:
    """The folder of spark.checkpoint.dir, or of the context's checkpoints, that all executors share; None where neither is set."""
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return set_.rstrip("/") if set_ else None


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Tables cut off from their lineage are read by whatever was made from them, so they go when the driver does."""

    def gone() -> None:
        with contextlib.suppress(Exception):  # the JVM may be down already
            delete(spark, path)

    atexit.register(gone)


def cut(df: DataFrame) -> DataFrame:
    """The rows written as a table in the shared folder and read again, which survives lost executors; without such a folder the plan stays whole, cached."""
    spark = df.sparkSession
    root = shared_folder(spark)
    if root is None or any(isinstance(f.dataType, T.NullType) for f in df.schema):
        return df.persist()
    path = f"{root}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """The rows for joins that deal both sides to the tasks. Spark judges a written table by the bytes of its files, which say little about its rows where they are much alike: joins would gather millions of them in the driver, to broadcast them."""
    return df.hint("merge")


def ship(spark: SparkSession) -> None:
    """Makes this package importable on the executors, once for each application."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    if getattr(sc, "_tracemill_shipped", False) or not root.is_dir():
        return
    target = os.path.join(tempfile.mkdtemp(prefix="tracemill-"), "tracemill.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(target)
    sc._tracemill_shipped = True
