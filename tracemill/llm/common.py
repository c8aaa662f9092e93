"""Helpers shared by the training-data operators: table access, scratch tables and Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import session

#: Rows and bytes of one Arrow batch sent to a Python worker; very long texts make batches of few rows.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20

_own_scratch: str | None = None


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches and makes this package importable on the executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    session.ship(spark)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where it is unset, local mode gets a folder of its own; a cluster gets an error."""
    global _own_scratch
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_scratch is None or not os.path.isdir(_own_scratch.removeprefix("file://")):
        _own_scratch = "file://" + tempfile.mkdtemp(prefix="tracemill-scratch-")
    return _own_scratch


class Scratch:
    """Written tables that cut lineage; they survive the loss of executors. drop() removes those no longer read; the rest go when the driver ends."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.made = spark, f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}", 0
        session.delete_at_exit(spark, self.root)

    def write(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}-{name}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Deals a small input with fewer partitions than cores over the cores, for stages that run Python; larger inputs are left as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow over a function that each task makes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            step = max(1, b.num_rows * BATCH_BYTES // max(b.nbytes, BATCH_BYTES))
            for at in range(0, b.num_rows, step):
                if (out := f(b.slice(at, step))) is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the two columns an operator reads, under fixed names: extra columns and their names can't clash."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def crc_mod(column, m: int):
    """crc32 of a column's decimal text, modulo m; null ids give null."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(m)
