"""Byte-level BPE encoding and decoding in numpy.

Texts are split by the pattern into pieces. The distinct pieces of a batch that are not known yet go into
length-bucketed, padded matrices of token ids. In every round each row merges its leftmost pair of minimum
rank; pairs are looked up in an open-addressing hash table, and merged rows are compacted to the left.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracemill.llm import common

NONE = np.int32(0x7FFFFFFF)
#: Pieces above this many bytes are merged one at a time over a heap: a round on the matrix costs their length.
LONG = 512
#: Known pieces a worker keeps; beyond that it starts anew, so memory is bounded.
KNOWN = 300_000


class PairTable:
    """Ranks of mergeable pairs in an open-addressing table with linear probing, looked up for whole arrays."""

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(len(left) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot, todo, self.probes = self._home(key), np.arange(len(key)), 0
        while len(todo):
            self.probes += 1
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = key[free]  # of several for one slot the last stays
            placed = self.keys[slot[todo]] == key[todo]
            self.values[slot[todo[placed]]] = merged[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * self.MULTIPLIER >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged token of each pair, or NONE."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._home(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        todo = np.flatnonzero((found != key) & (found != -1))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            slot[todo] = (slot[todo] + 1) & self.mask
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out


class ByteBPE:
    """Tokens are named by rank; a pair may merge if its bytes are a token, the lower rank first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.first = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        rows = [(ranks[b[:i]], ranks[b[i:]], r) for b, r in ranks.items() for i in range(1, len(b)) if b[:i] in ranks and b[i:] in ranks]
        table = np.array(rows, np.int64).reshape(-1, 3)
        self.pairs = PairTable(table[:, 0], table[:, 1], table[:, 2].astype(np.int32))
        self.known: dict[str, tuple[int, str, bytes]] = {}

    @classmethod
    @functools.lru_cache(maxsize=1)  # kept from task to task of a worker
    def load(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each nonempty piece."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        bucket = np.where(lengths > LONG, -1, np.ceil(np.log2(np.maximum(lengths, 4))).astype(np.int64))
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:  # a piece that is a token needs no merges
                out[i], bucket[i] = np.array([r], np.int32), -2
        for b in np.unique(bucket[bucket > -2]):
            rows = np.flatnonzero(bucket == b)
            if b == -1:
                for i in rows:
                    out[i] = np.array(self._long(pieces[i]), np.int32)
                continue
            step = max(1, (1 << 20) >> int(b))
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], lengths[part]), strict=True):
                    out[i] = ids
        return out

    def _matrix(self, pieces: list[bytes], lengths: np.ndarray) -> list[np.ndarray]:
        n, width = len(pieces), int(lengths.max())
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        done: list[np.ndarray] = [None] * n  # type: ignore[list-item]
        row = np.arange(n)
        rank = self._ranks(ids)
        length = lengths.copy()
        while True:
            if rank.shape[1]:
                at = rank.argmin(1)  # the leftmost of the lowest
                best = rank[np.arange(len(rank)), at]
            else:
                at, best = np.zeros(len(ids), np.int64), np.full(len(ids), NONE)
            stop = best == NONE
            if stop.any():
                for i in np.flatnonzero(stop):
                    done[row[i]] = ids[i, : length[i]].copy()
                go = ~stop
                if not go.any():
                    return done
                ids, rank, row, length, at, best = ids[go], rank[go], row[go], length[go], at[go], best[go]
            k = np.arange(len(ids))
            ids[k, at] = best
            column = np.arange(ids.shape[1])
            after = np.minimum(column + (column > at[:, None]), ids.shape[1] - 1)  # what follows the merged pair moves one place left
            ids = np.take_along_axis(ids, after, 1)
            length -= 1
            ids[column >= length[:, None]] = -1
            width = int(length.max())
            ids = np.ascontiguousarray(ids[:, :width])
            if width > 1:
                rank = np.take_along_axis(rank, np.minimum(column[: width - 1] + (column[: width - 1] > at[:, None]), rank.shape[1] - 1), 1)
                for shift in (-1, 0):  # only the two pairs with the new token have new ranks
                    p = at + shift
                    ok = np.flatnonzero((p >= 0) & (p < width - 1))
                    rank[ok, p[ok]] = self._pair(ids[ok, p[ok]], ids[ok, p[ok] + 1])
                rank[column[: width - 1] >= (length - 1)[:, None]] = NONE
            else:
                rank = np.empty((len(ids), 0), np.int32)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = self.pairs.get(a, np.maximum(b, 0))
        r[b < 0] = NONE
        return r

    def _ranks(self, ids: np.ndarray) -> np.ndarray:
        if ids.shape[1] < 2:
            return np.empty((len(ids), 0), np.int32)
        a, b = ids[:, :-1].ravel(), ids[:, 1:].ravel()
        return self._pair(np.maximum(a, 0), b).reshape(len(ids), -1)

    def _long(self, piece: bytes) -> list[int]:
        """The same merges, the lowest rank first and then the leftmost, over a heap and a linked list."""
        rank_of, text = self.ranks.get, piece
        end = [*range(1, len(text) + 1)]  # a token spans from its start to end[start]
        before = [*range(-1, len(text) - 1)]
        alive = bytearray(b"\x01" * len(text))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < len(text) and (r := rank_of(text[i : end[j]])) is not None:
                heap.append((r, i, end[j])) if building else heapq.heappush(heap, (r, i, end[j]))

        building = True
        for i in range(len(text)):
            offer(i)
        heapq.heapify(heap)
        building = False
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= len(text) or end[j] != stop:
                continue
            alive[j] = 0
            end[i] = stop
            if stop < len(text):
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < len(text):
            out.append(self.ranks[text[i : end[i]]])
            i = end[i]
        return out

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes_of[int(i)] for i in ids])

    def learn(self, pieces: list[str]) -> None:
        """Makes all pieces of a batch known: number of ids, their decimals joined by commas, and what they decode to."""
        if len(self.known) > KNOWN:
            self.known = {}
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        of, known = self.bytes_of, self.known
        for p, ids in zip(new, self.encode_pieces([p.encode() for p in new]), strict=True):
            ids = ids.tolist()
            known[p] = (len(ids), ",".join(map(str, ids)), b"".join([of[i] for i in ids]))

    def encode(self, text: str) -> list[int]:
        pieces = self.split(text)
        self.learn(pieces)
        return [int(i) for p in pieces for i in self.known[p][1].split(",")]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, on request, the ids of every whole text.

    Null texts count as empty: no token, hashes of nothing. Equal rows give equal rows, an empty table an empty
    one, and further columns are not read. A piece of any length is encoded whole.
    """
    extra = ", ids array<int>" if keep_ids else ""

    def make():
        bpe = ByteBPE.load(ranks_path, pattern)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            counts, ids_sha, out_sha, ids = [], [], [], []
            split = [bpe.split(t) for t in common.texts_of(b)]
            bpe.learn([p for pieces in split for p in pieces])
            known = bpe.known
            for pieces in split:
                got = [known[p] for p in pieces]
                counts.append(sum([g[0] for g in got]))
                joined = ",".join([g[1] for g in got])
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                out_sha.append(hashlib.sha256(b"".join([g[2] for g in got])).hexdigest())
                if keep_ids:
                    ids.append([int(i) for i in joined.split(",")] if joined else [])
            columns = [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(out_sha)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            return pa.RecordBatch.from_arrays(columns, names)

        return run

    docs = common.spread(common.id_and_text(docs, id_col, text_col))
    return common.map_batches(docs, make, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
