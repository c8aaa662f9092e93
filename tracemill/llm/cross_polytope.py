"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (signs, then a fast Hadamard transform, three times over) turns a unit vector; its cell is the
nearest signed axis. Each table has a rotation of its own. A query probes the cells of its largest coordinates in
every table; the rows found there are ranked again by their exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm import common

#: Queries of a cell that a task holds.
QUERIES = 1 << 14
#: Cells with fewer rows are never split.
LEAST_PART = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalized transform of the last axis, whose length is a power of two, in n log n steps."""
    n, h = x.shape[-1], 1
    x = x.copy()
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.stack([y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]], -2).reshape(x.shape)
        h *= 2
    return x / np.sqrt(n)


class CrossPolytope:
    def __init__(self, dim: int, tables: int, seed: int = 7):
        self.dim, self.width = dim, 1 << max(0, dim - 1).bit_length()
        self.signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (tables, 3, self.width))

    def rotate(self, x: np.ndarray, table: int) -> np.ndarray:
        y = np.zeros((len(x), self.width), np.float32)
        y[:, : self.dim] = x
        for s in self.signs[table]:
            y = hadamard(y * s)
        return y

    def cells(self, x: np.ndarray, table: int) -> np.ndarray:
        """The nearest signed axis: 2 * axis, one more for its negative side."""
        y = self.rotate(x, table)
        axis = np.abs(y).argmax(1)
        return 2 * axis + (y[np.arange(len(y)), axis] < 0)

    def probes(self, x: np.ndarray, table: int, count: int) -> np.ndarray:
        """For each vector and cell whether it is among the `count` nearest signed axes."""
        y = self.rotate(x, table)
        both = np.stack([y, -y], -1).reshape(len(y), -1)
        chosen = np.argpartition(-both, min(count, both.shape[1]) - 1, 1)[:, :count]
        out = np.zeros(both.shape, bool)
        np.put_along_axis(out, chosen, True, 1)
        return out


def unit(x: np.ndarray) -> np.ndarray:
    big = x / np.abs(x).max(1, keepdims=True)
    return big / np.linalg.norm(big, axis=1, keepdims=True)


def best(query: np.ndarray, x: np.ndarray, square: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows by exact Euclidean distance, ties to smaller ids; square: of each row the sum of its squares."""
    if len(ids) > 4 * k:  # far rows go by the expanded square, with room for its rounding
        scale = query @ query + square
        rough, room = scale - 2 * (x @ query), 1e-12 * scale
        bound = np.partition(rough + room, k - 1)[k - 1]
        near = rough - room <= bound
        x, ids = x[near], ids[near]
    d = np.sqrt(((x - query) ** 2).sum(1))
    order = np.lexsort((ids, d))[:k]
    return ids[order], d[order]


class Bucket:
    """The queries that probe a part of a cell, and the nearest rows of it met so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.vectors, self.top = k, [], [], {}

    def ask(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids.extend(ids.tolist())
        self.vectors.extend(x)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        square = (x * x).sum(1)
        for i, (q, vector) in enumerate(zip(self.ids, self.vectors, strict=True)):
            other = ids != q
            got = best(vector, x, square, ids, self.k) if other.all() else best(vector, x[other], square[other], ids[other], self.k)
            if i in self.top:
                a, d = (np.concatenate(z) for z in zip(self.top[i], got, strict=True))
                order = np.lexsort((a, d))[: self.k]
                got = a[order], d[order]
            self.top[i] = got

    def found(self) -> pa.RecordBatch | None:
        some = [(self.ids[i], a, d) for i, (a, d) in self.top.items() if len(a)]
        if not some:
            return None
        q = np.repeat([x[0] for x in some], [len(x[1]) for x in some])
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.concatenate([x[1] for x in some])), pa.array(np.concatenate([x[2] for x in some]))], ["query_id", "vec_id", "score"])


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, dim)


def search(vectors: DataFrame, every: int = 100, k: int = 10, tables: int = 16, probes: int = 5, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest rows found for each row whose id is divisible by `every`.

    The index, written once, holds all rows with their cell in each table. A row goes to its cells, a query to those
    it probes, and they meet there: nothing else is compared. A cell with more than a 256th of all rows is dealt to
    several tasks, and its queries to each of them; a cell that many queries probe is read once for each QUERIES of
    them. Tasks hold those queries and stream the rows. All rows are candidates but the query's own. Vectors that are
    null, zero, of another length than most, or hold null or non-finite components take no part; nor do null ids. Of
    rows with equal id and vector one counts. Equal distances go to the smaller id. No cell is capped; an empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = common.Scratch(spark, "ann")
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("x"))
    fine = F.forall("x", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf")))) & F.exists("x", lambda a: a != 0)
    v = v.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(fine)
    common_size = v.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if common_size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common_size["n"]
    hashes = CrossPolytope(dim, tables, seed)

    def add_cells(b: pa.RecordBatch) -> pa.RecordBatch:
        u = unit(_matrix(b, dim))
        cells = np.stack([hashes.cells(u, t) for t in range(tables)], 1).astype(np.int32)
        return pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), _lists(cells)], ["vec_id", "x", "cells"])

    def add_probes(b: pa.RecordBatch) -> pa.RecordBatch:
        u = unit(_matrix(b, dim))
        asked = [hashes.probes(u, t, probes) for t in range(tables)]
        count = int(asked[0][0].sum())
        cells = np.concatenate([np.nonzero(a)[1].reshape(len(u), count) for a in asked], 1).astype(np.int32)
        return pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), _lists(cells)], ["vec_id", "x", "cells"])

    one = v.where(F.size("x") == dim).dropDuplicates(["vec_id", "x"])
    schema = "vec_id long, x array<double>, cells array<int>"
    index = scratch.write(common.map_batches(one, lambda: add_cells, schema), "index")
    asked = scratch.write(common.map_batches(index.where(F.col("vec_id") % every == 0).select("vec_id", "x"), lambda: add_probes, schema), "queries")
    per = min(probes, 2 * hashes.width)

    def in_cells(df: DataFrame, each: int) -> DataFrame:
        return df.select("vec_id", "x", F.posexplode("cells").alias("place", "cell")).withColumn("t", (F.col("place") / each).cast("int")).drop("place")

    # at most tables * 2 * width rows: how many parts a cell has, and how many groups its queries
    share = F.greatest(F.lit(LEAST_PART), F.lit(max(1, index.count()) / 256))
    cells = in_cells(index, 1).groupBy("t", "cell").agg(F.ceil(F.count("*") / share).cast("int").alias("parts"))
    groups = in_cells(asked, per).groupBy("t", "cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
    sizes = F.broadcast(scratch.write(cells.join(groups, ["t", "cell"]), "cells"))
    own = F.xxhash64("vec_id", "x")
    rows = in_cells(index, 1).join(sizes, ["t", "cell"]).withColumn("part", F.pmod(own, "parts").cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    queries = in_cells(asked, per).join(sizes, ["t", "cell"]).withColumn("group", F.pmod(own, "groups").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["t", "cell", "part", "group"]
    both = rows.select(*key, F.lit(1).alias("kind"), "vec_id", "x").unionByName(queries.select(*key, F.lit(0).alias("kind"), "vec_id", "x"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bucket = None, Bucket(k)
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in (*key, "kind")], 1)
            ids, x = b.column("vec_id").to_numpy(), _matrix(b, dim)
            edges = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1), len(keys)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if at != (here := tuple(keys[i, :4])):
                    if (out := bucket.found()) is not None:
                        yield out
                    at, bucket = here, Bucket(k)
                (bucket.meet if keys[i, 4] else bucket.ask)(ids[i:j], x[i:j])
        if (out := bucket.found()) is not None:
            yield out

    found = both.repartition(*key).sortWithinPartitions(*key, "kind").mapInArrow(meet, "query_id long, vec_id long, score double")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.dropDuplicates().withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
