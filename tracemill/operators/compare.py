"""Operators on pairs of recordings: differences, intersections, baselines, deltas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys on one side only: side is `only_left` or `only_right`."""
    a, b = left.select(*key).distinct(), right.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("only_left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("only_right")))


def set_difference(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """By key the values on one side only, sorted and joined by commas; keys without a difference are left out."""
    sets = [df.groupBy(*key).agg(F.collect_set(value).alias(n)) for df, n in ((left, "l"), (right, "r"))]
    empty = F.array().cast(f"array<{dict(left.dtypes)[value]}>")
    both = sets[0].join(sets[1], key, "full").withColumns({n: F.coalesce(n, empty) for n in "lr"})
    text = lambda a, b: F.array_join(F.transform(F.array_sort(F.array_except(a, b)), lambda x: x.cast("string")), ",")
    return both.select(*key, text("l", "r").alias("removed"), text("r", "l").alias("added")).where("removed <> '' or added <> ''")


def in_all(recordings: list[DataFrame], key: list[str]) -> DataFrame:
    """Keys that every recording has."""
    return reduce(lambda a, b: a.join(b.select(*key), key, "left_semi"), recordings[1:], recordings[0].select(*key).distinct())


def not_in_baseline(findings: DataFrame, baseline: DataFrame, key: list[str]) -> DataFrame:
    return findings.join(baseline.select(*key), key, "left_anti")


def deltas(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """before, after, delta and status of each key, by full outer join."""
    both = before.select(*key, F.col(value).alias("before")).join(after.select(*key, F.col(value).alias("after")), key, "full")
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    both = both.withColumn("status", status).withColumns({c: F.coalesce(c, F.lit(0)) for c in ("before", "after")})
    return both.withColumn("delta", F.col("after") - F.col("before"))
