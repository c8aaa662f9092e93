"""Text files as numbered lines, without gathering a file in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def read(spark: SparkSession, path: str | list[str], recording: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """recording, path, line (from 1), text: every line of the files, blank ones too.

    recording: the first group of this pattern in the path, by default the name of the file's folder. Lines are
    numbered within a split of a file, and the splits' counts are added up: no task sees more than a split.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    at = W.partitionBy("path", "split")
    ranked = raw.withColumn("rank", F.row_number().over(at.orderBy("at")))
    before = W.partitionBy("path").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    starts = raw.groupBy("path", "split").count().select("path", "split", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    numbered = ranked.join(starts, ["path", "split"])
    return numbered.select(F.regexp_extract("path", recording, 1).alias("recording"), "path", (F.col("start") + F.col("rank")).cast("long").alias("line"), "text")


def blocks(lines: DataFrame, head, width: int = 1 << 16) -> DataFrame:
    """lines with block: the line of the latest head at or before it in its file; null before the first. Stretches of `width` lines are windows of their own, and the latest head before each is carried over."""
    rows = lines.withColumns({"_span": F.floor(F.col("line") / width).cast("long"), "_head": F.when(head, F.col("line"))})
    before = W.partitionBy("path").orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.groupBy("path", "_span").agg(F.max("_head").alias("_latest")).withColumn("_carried", F.max("_latest").over(before)).drop("_latest")
    w = W.partitionBy("path", "_span").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    inside = rows.withColumn("_block", F.last("_head", ignorenulls=True).over(w)).join(carried, ["path", "_span"])
    return inside.withColumn("block", F.coalesce("_block", "_carried")).select(*lines.columns, "block")
