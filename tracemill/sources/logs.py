"""Line-oriented side files: diagnostics on stderr, scope snapshots, compiler dependencies, presets."""

from __future__ import annotations

import posixpath
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill import session
from tracemill.sources import lines

BODY_LINES = 3
_HEAD = r"^CMake (Deprecation Warning|Warning|Error)(?: \(([^)]*)\))?(?: at (.+?)(?: \([^)]*\))?| in (.+))?:$"


def diagnostics(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Diagnostics of stderr: a header and up to three lines of its indented body, joined. Other text is skipped."""
    raw = lines.read(spark, path)
    column0 = (F.col("text") != "") & ~F.col("text").rlike(r"^[ \t]")
    rows = lines.blocks(raw, column0).where("block is not null")
    body = F.sort_array(F.collect_list(F.when((F.col("line") > F.col("block")) & (F.trim("text") != ""), F.struct("line", F.regexp_replace("text", r"^\s+|\s+$", "").alias("t")))))
    b = rows.groupBy("recording", "path", "block").agg(F.max(F.when(F.col("line") == F.col("block"), F.col("text"))).alias("head"), F.slice(body, 1, BODY_LINES).alias("body"))
    part = lambda n: F.regexp_extract("head", _HEAD, n)
    at = part(3)
    numbered = at.rlike(r":[0-9]+$")
    d = b.where(F.col("head").rlike(_HEAD)).select(
        "recording", "block", part(1).alias("base"), part(2).alias("tag"),
        F.when(numbered, F.regexp_extract(at, r"^(.*):[0-9]+$", 1)).when(at != "", at).otherwise(part(4)).alias("file"),
        F.when(numbered, F.regexp_extract(at, r":([0-9]+)$", 1).cast("long")).otherwise(F.lit(0)).cast("long").alias("line"),
        F.array_join(F.col("body.t"), " ").alias("message"))
    advice = (F.col("tag") == "dev") & F.col("message").startswith("Policy CMP") & F.col("message").contains(" is not set")
    d = d.withColumn("kind", F.when(advice, "policy").when(F.col("tag") != "", F.col("tag")).when(F.col("base").startswith("Dep"), "deprecation").otherwise(""))
    severity = F.when(F.col("base") == "Error", "error").when((F.col("kind") == "policy") & (F.col("base") == "Warning"), "note").otherwise("warning")
    order = W.partitionBy("recording").orderBy("block")
    return d.select("recording", F.row_number().over(order).cast("long").alias("diag_id"), severity.alias("severity"), "kind", "file", "line", "message")


def _unhex(values: pd.Series) -> pd.Series:
    def one(v: str | None) -> str:
        pairs = re.findall(r"..", v or "", re.S)
        return bytes(int(p, 16) for p in pairs if re.fullmatch(r"[0-9a-fA-F]{2}", p)).decode("utf-8", "replace")

    return values.map(one)


def snapshots(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """recording, snapshot (from 1), tag, name, value of scope snapshots; pairs that are no hexadecimal digits are skipped."""
    session.ship(spark)
    raw = lines.read(spark, path)
    rows = lines.blocks(raw, F.col("text").startswith("SNAPSHOT\t")).where("block is not null")
    heads = rows.where("line = block").select("path", "block", F.substring_index("text", "\t", -1).alias("tag"), F.dense_rank().over(W.partitionBy("path").orderBy("block")).alias("snapshot"))
    unhex = F.pandas_udf(_unhex, "string")
    body = rows.where((F.col("line") > F.col("block")) & F.col("text").contains("\t"))
    return body.join(heads, ["path", "block"]).select("recording", "snapshot", "tag", F.substring_index("text", "\t", 1).alias("name"), unhex(F.substring_index("text", "\t", -1)).alias("value"))


def _normal(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: p and posixpath.normpath(p))


def headers(spark: SparkSession, path: str | list[str], tus: DataFrame, build_dir: str) -> DataFrame:
    """tu_headers from the text of `ninja -t deps`: an object CMakeFiles/<target>.dir/<source>.o belongs to the unit of that target whose path ends so."""
    session.ship(spark)
    raw = lines.read(spark, path)
    rows = lines.blocks(raw, ~F.col("text").rlike(r"^\s") & F.col("text").contains(": #deps"))
    objects = r"CMakeFiles/([^/]+)\.dir/(.+)\.o(?:bj)?: #deps"
    heads = rows.where("line = block").select("path", "block", F.regexp_extract("text", objects, 1).alias("target"), F.regexp_extract("text", objects, 2).alias("suffix")).where("target <> ''")
    normal = F.pandas_udf(_normal, "string")
    dep = F.trim("text")
    body = rows.where("line > block").where(F.trim("text") != "").select("recording", "path", "block", normal(F.when(dep.startswith("/"), dep).otherwise(F.concat(F.lit(build_dir.rstrip("/") + "/"), dep))).alias("header_path"))
    found = body.join(heads, ["path", "block"]).join(tus, ["recording", "target"])
    return found.where((F.col("source_path") == F.col("suffix")) | F.col("source_path").endswith(F.concat(F.lit("/"), F.col("suffix")))).where("header_path <> source_path").select("recording", "target", "source_path", "header_path").distinct()


def presets(spark: SparkSession, path: str, key: str = "presets_json") -> DataFrame:
    """The text of preset files as rows of meta."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("recording"), F.lit(key).alias("key"), "value")
    return raw
