"""Sharding by histogram sort.

Rows are ordered by key. Exact bytes and rows below probe keys are counted in every partition and summed; probes
close in on each boundary between shards until it is near enough to its share of the bytes. Only then the rows
move, once, and are numbered in key order. Neither texts nor keys come to the driver: only the sums at the probes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm import common

WORD = 1 << 64
#: Rows of a piece of a shard, on average, that a task sorts.
PIECE = 4_000_000


def _keys(b: pa.RecordBatch) -> np.ndarray:
    """Sortable 16-byte keys: the id (null first), then the tie."""
    k = np.empty((b.num_rows, 2), ">u8")
    ids = np.array(b.column("key_id").to_numpy(zero_copy_only=False), np.int64)
    k[:, 0] = ids.view(np.uint64) ^ np.uint64(1 << 63)
    k[:, 1] = np.array(b.column("tie").to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
    return k.view("S16").ravel()


def _probes(values: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(v.to_bytes(16, "big") for v in values), "S16")


def _sums(rows: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Bytes and rows with keys below each of the sorted probes."""
    edges = _probes(probes)

    def count(batches):
        total = np.zeros((2, len(edges) + 1), np.int64)
        for b in batches:
            at = np.searchsorted(edges, _keys(b), side="right")
            total[0] += np.bincount(at, weights=b.column("size").to_numpy(), minlength=len(edges) + 1).astype(np.int64)
            total[1] += np.bincount(at, minlength=len(edges) + 1)
        some = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[0][some]), pa.array(total[1][some])], ["at", "bytes", "n"])

    sums = rows.mapInArrow(count, "at int, bytes long, n long").groupBy("at").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()
    out = np.zeros((2, len(edges) + 1), np.int64)
    for r in sums:
        out[:, r["at"]] = r["bytes"], r["n"]
    below = out.cumsum(1)[:, :-1]
    return below[0].tolist(), below[1].tolist()


def shard(docs: DataFrame, shards: int, tolerance: float = 0.002, least_parts: int = 8, width: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; size is the text's UTF-8 bytes plus 16.

    Shards are runs of the rows in id order whose sizes differ from equal shares by the tolerance or by a row.
    Null ids stand first, null texts have no byte and crc 0. Rows of one id, equal rows too, are told apart by a
    hash of the text and their place in the input, so a group of any size splits. Slots count from 0 without a
    gap. An empty table gives an empty one. Each shard is sorted in pieces of about PIECE rows, or in least_parts of
    fewer, so no task sorts more however large the table is.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[id_col].cast("long"), F.lit(-(1 << 63))).alias("key_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text, F.monotonically_increasing_id()).alias("tie"),
    )
    scratch = common.Scratch(spark, "shard")
    rows = scratch.write(rows, "rows")  # small: without the texts
    total = rows.agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("key_id").alias("lo"), F.max("key_id").alias("hi")).first()
    parts = max(least_parts, -(-total["n"] // (shards * PIECE)))
    cuts = _boundaries(rows, total, shards * parts, parts, tolerance, width) if total["n"] else []
    edges = _probes(cuts)

    def place(batches):
        for b in batches:
            at = np.searchsorted(edges, _keys(b), side="right")
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "key_id", "tie", "size", "text_crc32")), pa.array(at, pa.int32())], ["doc_id", "key_id", "tie", "size", "text_crc32", "part"])

    first = [0] * (shards * parts)
    if cuts:
        below = [0, *_sums(rows, cuts)[1]] if cuts else [0]
        first = [n - below[k - k % parts] for k, n in enumerate(below)]
    placed = rows.mapInArrow(place, "doc_id long, key_id long, tie long, size long, text_crc32 long, part int")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("key_id", "tie"))
    start = F.array(*[F.lit(int(n)) for n in first])
    return placed.withColumn("rank", rank).select("doc_id", "size", "text_crc32", F.floor(F.col("part") / parts).cast("int").alias("shard"), (F.col("rank") - 1 + start[F.col("part")]).cast("long").alias("slot"))


def _boundaries(rows: DataFrame, total, pieces: int, parts: int, tolerance: float, width: int) -> list[int]:
    """The first keys of pieces 1, 2, ...; those between shards, every parts-th, are the exact ones."""
    share = total["bytes"] / pieces
    key = lambda i: (i + (1 << 63)) * WORD
    low, high = key(total["lo"]), key(total["hi"]) + WORD  # nothing is below low, all is below high
    brackets = {k: [(low, 0, 0), (high, total["bytes"], total["n"])] for k in range(1, pieces)}
    done: dict[int, int] = {}
    while brackets:
        wanted = {k: sorted({lo[0] + (hi[0] - lo[0]) * i // (width + 1) for i in range(1, width + 1)} - {lo[0]}) for k, (lo, hi) in brackets.items()}
        probes = sorted({p for ps in wanted.values() for p in ps})
        sums = dict(zip(probes, zip(*_sums(rows, probes), strict=True), strict=True)) if probes else {}
        for k, ps in wanted.items():
            target = k * share
            points = [brackets[k][0], *((p, *sums[p]) for p in ps), brackets[k][1]]
            i = max(i for i, p in enumerate(points) if p[1] <= target or i == 0)
            lo, hi = points[i], points[min(i + 1, len(points) - 1)]
            near = min((lo, hi), key=lambda p: abs(p[1] - target))
            close = tolerance * share * parts if k % parts == 0 else 0.1 * share
            if abs(near[1] - target) <= close or hi[2] - lo[2] <= 1 or hi[0] - lo[0] <= 1:
                done[k] = near[0]
            else:
                brackets[k] = [lo, hi]
        brackets = {k: b for k, b in brackets.items() if k not in done}
    cuts = [done[k] for k in range(1, pieces)]
    return list(np.maximum.accumulate(np.array(cuts, object))) if cuts else []
