"""Operators on ordered events: self time, next and dominating writes, soft and hard state, scopes by depth.

All take the columns by name. Order columns must be dense or at least unique within a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


#: Places of one order that a window takes at once.
WIDTH = 1 << 16


def _spans(order: str, by: list[str]) -> tuple[Column, W]:
    """The stretch of WIDTH places that a row is in, and the window over stretches."""
    return F.floor(F.col(order) / WIDTH).cast("long"), (W.partitionBy(*by) if by else W.partitionBy()).orderBy("_span")


def self_time(events: DataFrame, time: Column, order: str, by: list[str] | None = None, name: str = "self_us") -> DataFrame:
    """Time until the next event, at least 0; 0 for the last. by: the recording, so that each has a sequence of its own.

    order: integers, unique and nearly dense. No task sees more than WIDTH places: the last event of a stretch is
    followed by the first of the next one, and only those firsts are put in one order.
    """
    by = by or []
    span, over = _spans(order, by)
    rows = events.withColumns({"_span": span, "_time": time})
    inside = W.partitionBy(*by, "_span").orderBy(order)
    firsts = rows.groupBy(*by, "_span").agg(F.min_by("_time", order).alias("_first"))
    firsts = firsts.withColumn("_following", F.lead("_first").over(over)).drop("_first")
    rows = rows.withColumn("_next", F.lead("_time").over(inside)).join(firsts, [*by, "_span"])
    gap = (F.coalesce("_next", "_following") - F.col("_time")).cast("long")
    return rows.withColumn(name, F.coalesce(F.greatest(gap, F.lit(0)), F.lit(0)).cast("long")).select(*events.columns, name)


def sequence(rows: DataFrame, order: str, by: list[str], time: Column, rank: str, gap: str) -> DataFrame:
    """Rows with their rank from 1 in the order within `by`, and the time to the next one as self_time gives it; both stretch by stretch, in one pass."""
    span, over = _spans(order, by)
    spans = rows.withColumns({"_span": span, "_time": time})
    inside = W.partitionBy(*by, "_span").orderBy(order)
    each = spans.groupBy(*by, "_span").agg(F.count("*").alias("_n"), F.min_by("_time", order).alias("_first"))
    each = each.withColumns({"_before": F.coalesce(F.sum("_n").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "_following": F.lead("_first").over(over)}).drop("_n", "_first")
    spans = spans.withColumns({"_rank": F.row_number().over(inside), "_next": F.lead("_time").over(inside)}).join(each, [*by, "_span"])
    step = (F.coalesce("_next", "_following") - F.col("_time")).cast("long")
    spans = spans.withColumns({rank: (F.col("_rank") + F.col("_before")).cast("long"), gap: F.coalesce(F.greatest(step, F.lit(0)), F.lit(0)).cast("long")})
    return spans.select(*rows.columns, rank, gap)


def next_write(writes: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each write with the next one of its key: next_<column>; null for the last."""
    w = W.partitionBy(*key).orderBy(order)
    return writes.withColumns({f"next_{c}": F.lead(c).over(w) for c in [order, *columns]})


def dominating_write(reads: DataFrame, writes: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """As-of join: each read with the latest earlier write of its key, by one window over both. A null value clears what was written."""
    kind = reads.select(*key, order, F.lit(1).alias("is_read"), F.lit(None).cast("long").alias("write_id"), F.lit(None).cast(writes.schema[value].dataType).alias("value"))
    rows = kind.unionByName(writes.select(*key, order, F.lit(0).alias("is_read"), F.col(order).cast("long").alias("write_id"), F.col(value).alias("value")))
    w = W.partitionBy(*key).orderBy(order, F.desc("is_read")).rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("is_read") == 0, F.struct("write_id", "value")), ignorenulls=True).over(w)
    found = rows.withColumn("last", last).where("is_read = 1")
    alive = F.col("last.value").isNotNull()
    return found.select(*key, order, F.when(alive, F.col("last.write_id")).alias("write_id"), F.when(alive, F.col("last.value")).alias("value"))


def soft_hard(rows: DataFrame, key: list[str], order: str, hard: Column, value: Column) -> DataFrame:
    """State before each row: the last hard value, else the first soft one."""
    before = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    last_hard = F.last(F.when(hard, F.struct(value.alias("v"))), ignorenulls=True).over(before)
    first_soft = F.first(F.when(~hard, F.struct(value.alias("v"))), ignorenulls=True).over(before)
    return rows.withColumn("state", F.coalesce(last_hard, first_soft)["v"])


def scopes_by_depth(events: DataFrame, by: list[str], depth: str, order: str) -> DataFrame:
    """opens: the event is one level below the one before it; scope: the latest opening at its own depth."""
    w = W.partitionBy(*by).orderBy(order)
    opened = events.withColumn("opens", F.coalesce(F.lag(depth).over(w) + 1 == F.col(depth), F.lit(False)))
    at_depth = W.partitionBy(*by, depth).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return opened.withColumn("scope", F.last(F.when(F.col("opens"), F.col(order)), ignorenulls=True).over(at_depth))


def first_per_key(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in execution order."""
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")
