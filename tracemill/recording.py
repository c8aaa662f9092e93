"""Recordings on disk: one folder a table, partitioned by recording, so that comparisons read only what they need."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import model, session, syntax
from tracemill.replay import crosscheck, sequential
from tracemill.sources import logs, replies, trace

REQUIRED = ["events", "scopes", "var_writes", "var_reads"]


def ingest(
    spark: SparkSession, traces: str | list[str], sources: DataFrame, source_dir: str, build_dir: str | None = None, stderr: str | list[str] | None = None, seeds: DataFrame | None = None,
    reply_folders: dict[str, str] | None = None, deps: str | list[str] | None = None, presets: str | None = None, snapshots: str | list[str] | None = None, snapshot_file: str | None = None,
) -> dict[str, DataFrame]:
    """All tables of the recordings whose traces these are. Raises sources.trace.TraceError before anything is built if a trace can't be used.

    sources: recording, path, content. reply_folders: of the file API, by recording. deps: texts of `ninja -t deps`.
    presets: files whose text goes to meta. snapshots: variables dumped by file(APPEND) to snapshot_file, which the
    replay must agree with, or replay.crosscheck.ReplayError is raised. The trace's lines, events, parsed sources and
    the replay's rows are cut off from their lineage once each, as several tables read them.
    """
    seen = session.cut(trace.scan(spark, traces))
    trace.check(spark, traces, seen)
    events = session.dealt(session.cut(trace.events(spark, traces, seen)))
    parsed = {n: session.dealt(session.cut(df)) for n, df in syntax.tables(sources, source_dir, build_dir).items()}
    log = session.dealt(session.cut(sequential.log(events, parsed["commands"], parsed["nodes"], seeds)))
    tables = parsed | sequential.tables(events, log)
    if snapshots and snapshot_file:
        crosscheck.check(tables["events"], tables["scopes"], tables["var_writes"], logs.snapshots(spark, snapshots), snapshot_file)
    if stderr:
        tables["configure_diagnostics"] = logs.diagnostics(spark, stderr)
    if reply_folders:
        replied = [replies.read(spark, folder, name, source_dir, events) for name, folder in reply_folders.items()]
        of = {n: session.cut(reduce(DataFrame.unionByName, [r[n] for r in replied])) for n in ("targets", "usage_reqs", "tus")}
        tables |= {"targets": replies.merge(tables["targets"], of["targets"]), "usage_reqs": tables["usage_reqs"].unionByName(of["usage_reqs"]), "tus": of["tus"]}
        if deps:
            tables["tu_headers"] = logs.headers(spark, deps, of["tus"], build_dir or source_dir)
    if presets:
        none = spark.createDataFrame([], model.TABLES["meta"])
        tables["meta"] = put_meta(none, logs.presets(spark, presets).withColumn("seq", F.lit(1).cast("bigint")))
    return tables


def save(tables: dict[str, DataFrame], path: str) -> None:
    """Writes tables into a folder beside their place, then moves them there, events last: a folder without them is no recording.

    FileExistsError if a whole recording is there already. What an interrupted save left behind is replaced.
    """
    spark = next(iter(tables.values())).sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = path.rstrip("/")
    if fs.exists(fs_path(f"{root}/events/_SUCCESS")):
        raise FileExistsError(f"{path} holds a recording")
    staging = f"{root}/_staging-{uuid.uuid4().hex}"
    try:
        # each is a job or more of its own, and small ones leave most cores idle
        with ThreadPoolExecutor(4) as pool:
            list(pool.map(lambda n: tables[n].write.partitionBy("recording").parquet(f"{staging}/{n}"), tables))
        for name in sorted(tables, key=lambda n: n == "events"):
            fs.delete(fs_path(f"{root}/{name}"), True)
            if not fs.rename(fs_path(f"{staging}/{name}"), fs_path(f"{root}/{name}")):
                raise OSError(f"{root}/{name} could not be moved into place")
    finally:
        fs.delete(fs_path(staging), True)


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a folder that save() wrote; ValueError if the events are missing. Optional tables that aren't there are left out."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [n for n in model.TABLES if fs.exists(fs_path(f"{path.rstrip('/')}/{n}/_SUCCESS"))]
    missing = [n for n in REQUIRED if n not in there]
    if missing:
        raise ValueError(f"{path} is no recording: {', '.join(missing)} missing")
    read = lambda n: spark.read.schema(model.TABLES[n]).parquet(f"{path.rstrip('/')}/{n}")
    return {n: read(n).withColumn("recording", F.col("recording").cast("string")) for n in there}


def put_meta(meta: DataFrame, entries: DataFrame) -> DataFrame:
    """meta with entries (recording, key, value, seq) put in: of a key the value with the largest seq counts, and any counts more than what was there."""
    old = meta.select("recording", "key", "value", F.lit(None).cast("bigint").alias("seq"))
    return old.unionByName(entries.select("recording", "key", "value", "seq")).groupBy("recording", "key").agg(F.max_by("value", F.struct(F.col("seq").isNotNull(), "seq")).alias("value"))
