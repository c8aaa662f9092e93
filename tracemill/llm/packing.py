"""Best-fit packing of token sequences under several capacities at once.

Pieces of equal length are alike to every constraint, so the packing is found on the histogram of lengths, whose
size is bounded by the sequence length whatever the corpus. Groups of equal bins are filled at once, longest
pieces first; the bin is chosen by the weighted dot product of piece and residual, or by the smallest weighted
norm of what remains, over residual tokens, documents and attention cost. Pieces then find their place by their
rank among those of their length.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm import common

#: Texts of these characters give the same ids by both libraries' rules for white space and letters; others, and special strings, go to `tokenizers`.
PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]|<\|")


@dataclass(frozen=True)
class Limits:
    tokens: int
    docs: int
    attention: int
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"  # or "dot"
    piece: int | None = None  # tokens of the longest piece; a sequence's if None

    @property
    def longest(self) -> int:
        """Tokens of the longest piece that every capacity has room for."""
        return max(1, min(self.tokens, math.isqrt(self.attention), self.piece or self.tokens))


class Encoder:
    """Ids by the tokenizers library's file; plain texts by the same vocabulary as ranks, which is several times faster."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    @functools.lru_cache(maxsize=1)  # kept from task to task of a worker
    def load(cls, json_path: str, ranks_path: str, pattern: str) -> Encoder:
        return cls(json_path, ranks_path, pattern)

    def encode(self, text: str) -> list[int]:
        return self.slow.encode(text, add_special_tokens=False).ids if PLAIN.search(text) else self.fast.encode_ordinary(text)


def cut(n: int, most: int) -> list[int]:
    """Lengths of a document's pieces: all but the first are full."""
    return [n % most or most, *[most] * ((n - 1) // most)] if n > most else [n]


def pieces_of(docs: DataFrame, limits: Limits, json_path: str, ranks_path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, piece, start, length and ids_crc32 of each piece; row tells equal ids apart."""

    def make():
        encoder = Encoder.load(json_path, ranks_path, pattern)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for d, r, t in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), common.texts_of(b), strict=True):
                ids = encoder.encode(t)
                ids.append(end_id)
                ids = np.array(ids, "<u4")
                at = 0
                for k, n in enumerate(cut(len(ids), limits.longest)):
                    out.append((d, r, k, at, n, zlib.crc32(ids[at : at + n])))
                    at += n
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "row", "piece", "start", "length", "ids_crc32"])

        return run

    rows = common.spread(common.id_and_text(docs, id_col, text_col)).withColumn("row", F.monotonically_increasing_id())
    return common.map_batches(rows, make, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], limits: Limits) -> tuple[np.ndarray, int]:
    """Places for all pieces, and the number of bins.

    A row (length, first, count, bin, offset): the pieces of that length with ranks first, first + 1, ... go to
    bins bin, bin + 1, ... at that offset. Many copies of a length in one bin take a row each.
    """
    most = np.array([limits.tokens, limits.docs, limits.attention], np.float64)
    weights = np.array(limits.weights)
    residual = np.empty((0, 3))  # of each group of equal bins
    groups: list[list[int]] = []  # first bin, number of bins
    places, bins = [], 0
    for length in sorted(histogram, reverse=True):
        item = np.array([length, 1, length * length], np.float64)
        if (item > most).any():
            raise ValueError(f"a piece of {length} tokens fits no bin")
        left, rank = histogram[length], 0

        def fill(k: int, each: int, count: int, length=length, item=item) -> None:
            """Puts `each` pieces into each of the first `count` bins of group k; the rest of the group becomes another."""
            nonlocal residual, rank, left
            first, n = groups[k]
            for c in range(each):
                places.append((length, rank, count, first, limits.tokens - int(residual[k, 0]) + c * length))
                rank, left = rank + count, left - count
            if count < n:
                groups.append([first + count, n - count])
                residual = np.vstack([residual, residual[k]])
                groups[k] = [first, count]
            residual[k] -= each * item

        while left:
            fits = np.flatnonzero((residual >= item).all(1)) if len(groups) else []
            if len(fits):
                rest, scaled = (residual[fits] - item) / most, item / most
                value = (weights * rest * rest).sum(1) if limits.rule == "norm" else -(weights * scaled * residual[fits] / most).sum(1)
                k = int(fits[value.argmin()])
                each = int((residual[k] // item).min()) if limits.rule == "norm" else 1  # a filled bin fits the next even better
            else:
                each, k = int((most // item).min()), len(groups)
                n = max(1, left // each)
                groups.append([bins, n])
                residual, bins = np.vstack([residual, most]), bins + n
            each = min(each, left)
            fill(k, each, min(groups[k][1], max(1, left // each)))
        full = residual[:, 0] < 1
        if full.any():
            keep = np.flatnonzero(~full)
            residual, groups = residual[keep], [groups[i] for i in keep]
    return np.array(places, np.int64).reshape(-1, 5), bins


def pack(pieces: DataFrame, limits: Limits, salts: int = 64) -> DataFrame:
    """The pieces with sequence_id and offset; sequences fill from offset 0 without a gap. An empty table gives an empty one.

    A length may hold a third of all pieces: ranks are counted in `salts` parts of each length, then shifted by
    the sizes of the parts before.
    """
    spark = pieces.sparkSession
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    got = sizes.collect()  # at most limits.tokens * salts rows
    histogram: dict[int, int] = {}
    starts: dict[tuple[int, int], int] = {}
    for r in sorted(got, key=lambda r: (r["length"], r["salt"])):
        starts[r["length"], r["salt"]] = histogram.get(r["length"], 0)
        histogram[r["length"]] = histogram.get(r["length"], 0) + r["n"]
    places, _ = plan(histogram, limits)
    order = np.lexsort((places[:, 1], places[:, 0]))
    shared = spark.sparkContext.broadcast((places[order], starts))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "row", "piece")))

    def place(batches):
        places, starts = shared.value
        key = places[:, 0] << 40 | places[:, 1]
        for b in batches:
            length, salt = b.column("length").to_numpy(), b.column("salt").to_numpy()
            rank = b.column("rank").to_numpy() - 1 + np.array([starts[x] for x in zip(length.tolist(), salt.tolist(), strict=True)], np.int64)
            row = places[np.searchsorted(key, length << 40 | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, limits: Limits, json_path: str, ranks_path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenizes every whole text once, cuts what is longer than limits.longest and packs the pieces.

    Null texts count as empty: one piece, the end id. Null and repeated ids are kept as rows of their own; further
    columns are not read.
    """
    scratch = common.Scratch(docs.sparkSession, "pack")
    pieces = scratch.write(pieces_of(docs, limits, json_path, ranks_path, pattern, end_id, id_col, text_col), "pieces")
    return pack(pieces, limits)
