"""The replay held against what the build itself said: variables dumped while it ran.

The values are found again by joins, from the writes of a scope and those around it, not by the state that the replay
kept: the last write of each scope that the snapshot could see, and of those the innermost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SHOWN = 10


class ReplayError(ValueError):
    """The replay says otherwise than the build."""


def mismatches(events: DataFrame, scopes: DataFrame, writes: DataFrame, snapshots: DataFrame, file: str) -> DataFrame:
    """recording, tag, name, replayed, dumped where the two differ.

    snapshots: as sources.logs gives them; the n-th of a recording was dumped by its n-th file(APPEND) to `file`. The
    cache is not asked, as the dump holds ordinary variables only; nor are values that the trace doesn't show.
    """
    dumps = events.where((F.col("cmd_lower") == "file") & (F.get("args", F.lit(0)) == "APPEND") & (F.get("args", F.lit(1)) == file))
    marks = dumps.select("recording", "scope_id", F.col("event_id").alias("at"), F.row_number().over(W.partitionBy("recording").orderBy("event_id")).alias("snapshot"))
    asked = snapshots.select("recording", F.col("snapshot").cast("int").alias("snapshot"), "tag", "name", F.col("value").alias("dumped")).join(marks, ["recording", "snapshot"])
    around = scopes.select("recording", "scope_id", F.posexplode("chain").alias("depth", "s")).select("recording", "scope_id", "depth", F.substring_index("s", ":", 1).cast("long").alias("holder"), F.substring_index("s", ":", -1).alias("kind"))
    held = writes.where("scope_id is not null").select("recording", F.col("scope_id").alias("holder"), "name", "write_id", F.col("event_id").alias("written"), "value", "write_kind")
    seen = asked.join(around, ["recording", "scope_id"]).join(held, ["recording", "holder", "name"]).where("written <= at").where("kind <> 'macro' or write_kind = 'synthetic'")
    key = ["recording", "snapshot", "tag", "name", "dumped"]
    last = seen.groupBy(*key, "depth").agg(F.max_by(F.struct("value", "write_kind"), "write_id").alias("w")).where("w.write_kind <> 'unset'")
    inner = last.groupBy(*key).agg(F.max_by("w.value", "depth").alias("replayed"))
    return inner.where("replayed <> dumped").select("recording", "tag", "name", "replayed", "dumped")


def check(*args) -> None:
    """Raises ReplayError with the first of the mismatches."""
    found = mismatches(*args).orderBy("recording", "tag", "name").limit(SHOWN).collect()
    if found:
        raise ReplayError("the replay differs from the dumped variables: " + "; ".join(f"{r.recording}, snapshot {r.tag!r}: {r.name} is {r.replayed!r}, dumped as {r.dumped!r}" for r in found))
