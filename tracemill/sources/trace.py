"""Traces: one JSON object a line, the first line a version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import temporal
from tracemill.sources import lines

EVENT = "file string, line bigint, line_end bigint, cmd string, args array<string>, time double, frame bigint, global_frame bigint, _bad string"
HEADER = "version struct<major:bigint,minor:bigint>, _bad string"
MAJOR = 1
CORRUPT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}


class TraceError(ValueError):
    """A trace that can't be used."""


def scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of traces as events, with problem: why a line can't be used, else null. Blank lines are left out.

    Absent fields: args empty, time 0, frames 0. A header of another major version and a depth of 0 are problems.
    """
    raw = lines.read(spark, path)
    h, e = F.from_json("text", HEADER, CORRUPT), F.from_json("text", EVENT, CORRUPT)
    first = F.col("line") == 1
    rows = raw.where(first | (F.trim("text") != "")).select("*", F.when(first, h).alias("h"), F.when(~first, e).alias("e"))
    absent = F.col("e._bad").isNotNull() | F.col("e.file").isNull() | F.col("e.line").isNull() | F.col("e.cmd").isNull()
    problem = (
        F.when(first & (F.col("h._bad").isNotNull() | F.col("h.version.major").isNull()), "no version header")
        .when(first & (F.col("h.version.major") != MAJOR), "unknown major version")
        .when(~first & absent, "malformed event")
        .when(~first & (F.coalesce("e.global_frame", F.lit(0)) < 1), "no depth"))
    zero = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit(0))
    return rows.select(
        "recording", "path", F.col("line").alias("trace_line"), problem.alias("problem"), "e.file", "e.line", "e.cmd", F.lower("e.cmd").alias("cmd_lower"),
        F.coalesce("e.args", F.array().cast("array<string>")).alias("args"), zero("time").cast("double").alias("time_abs"), zero("frame").alias("frame"), zero("global_frame").alias("global_frame"))


def check(spark: SparkSession, path: str | list[str], seen: DataFrame | None = None) -> None:
    """Raises TraceError on the first unusable line of any trace, or a trace without lines. seen: what scan gave, if it is at hand."""
    seen = scan(spark, path) if seen is None else seen
    bad = seen.where("problem is not null").orderBy("path", "trace_line").select("path", "trace_line", "problem").first()
    if bad:
        raise TraceError(f"{bad.path}: line {bad.trace_line}: {bad.problem}")
    for p in [path] if isinstance(path, str) else path:
        # Spark drops files without bytes from every scan, so they are looked up in the file system
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        for status in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []:
            if status.isFile() and status.getLen() == 0:
                raise TraceError(f"{status.getPath()}: line 1: no version header")


def events(spark: SparkSession, path: str | list[str], seen: DataFrame | None = None) -> DataFrame:
    """Events with event_id dense from 1 in the order of the trace and the time to the next event; an unusable line fails the query. seen: as for check."""
    rows = scan(spark, path) if seen is None else seen
    fail = F.raise_error(F.concat_ws(": ", "path", F.concat(F.lit("line "), F.col("trace_line")), "problem"))
    good = rows.where(F.when(F.col("problem").isNotNull(), fail.isNull()).otherwise(F.lit(True))).where("trace_line > 1")
    return number(good, "trace_line").drop("path", "trace_line", "problem")


def number(rows: DataFrame, order: str) -> DataFrame:
    """event_id and elapsed_us of rows ordered, by integers, within their recording; no task sees a whole recording."""
    micros = F.round(F.col("time_abs") * 1e6).cast("long")
    return temporal.sequence(rows, order, ["recording"], micros, "event_id", "elapsed_us").withColumn("args_json", F.to_json("args"))


def executed_files(events: DataFrame) -> DataFrame:
    return events.select("recording", "file").distinct()
