"""Exact token counts at every prefix of a text, by dynamic programming over a BPE vocabulary of pieces.

The encoding of a prefix ends in one certain piece: of the pieces that end there, the only one that may follow
the last piece of what stands before it. Two pieces may follow each other if encoding their joined text gives
just these two. So count[i] = count[i - len(piece)] + 1 is exact for every prefix, and truncation and budget
questions are look-ups. No piece of such a vocabulary has a space after another character, and none holds a
character that is not itself a piece: texts fall apart there, and the table of each different chunk is kept.
"""

from __future__ import annotations

import functools
import re
from array import array
from operator import sub

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tracemill.llm import common

SPACE = "▁"
#: Chunks and pairs a worker keeps; beyond that it starts anew, so memory is bounded.
KNOWN_CHUNKS = 300_000
KNOWN_PAIRS = 1_000_000


class PrefixCounter:
    def __init__(self, pieces: dict[str, float]):
        """pieces: of the vocabulary, with their scores; the pair with the highest score merges first, the leftmost of equals."""
        self.score = pieces
        self.names, self.may = list(pieces), {}
        self.known: dict[str, tuple[int, ...]] = {}
        inner = [p for p in pieces if SPACE in p.lstrip(SPACE)]
        if inner:
            raise ValueError(f"pieces with a space inside: {inner[:3]}")
        # a piece that its own text doesn't give is never the last of an encoding
        self.found = ahocorasick.Automaton()
        for k, p in enumerate(self.names):
            if len(p) == 1 or self.merge(p) == [p]:
                self.found.add_word(p, (k, len(p)))
        self.found.make_automaton()
        self.chunks = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall if not any("\n" in p for p in pieces) else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    @classmethod
    @functools.lru_cache(maxsize=1)  # kept from task to task of a worker
    def load(cls, path: str) -> PrefixCounter:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        return cls({sp.id_to_piece(i): sp.get_score(i) for i in ids})

    def merge(self, text: str) -> list[str]:
        """The BPE encoding of a short text, as strings, by its merges."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(-np.inf, 0))
            if best[0] == -np.inf:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _may_follow(self, a: int, b: int) -> bool:
        if len(self.may) > KNOWN_PAIRS:
            self.may.clear()
        ok = self.may[a << 32 | b] = self.merge(self.names[a] + self.names[b]) == [self.names[a], self.names[b]]
        return ok

    def chunk(self, text: str) -> list[int]:
        """Token counts at the prefixes of 0, 1, ... characters of a chunk."""
        count, last, may, i = [0], [-1], self.may, 0
        for end, (b, n) in self.found.iter(text):  # pieces that end at a place, the longest first
            if end < i:
                continue
            while i < end:  # unknown: its UTF-8 bytes are its tokens, and nothing merges across it
                count.append(count[-1] + len(text[i].encode("utf-8", "surrogatepass")))
                last.append(-1)
                i += 1
            a = last[end + 1 - n]
            if a < 0 or (ok := may.get(a << 32 | b)) or (ok is None and self._may_follow(a, b)):
                count.append(count[end + 1 - n] + 1)
                last.append(b)
                i += 1
        while i < len(text):
            count.append(count[-1] + len(text[i].encode("utf-8", "surrogatepass")))
            i += 1
        return count

    def table(self, chunk: str) -> tuple[int, bytes]:
        """The count of a whole chunk, and the change of the count with each of its characters, as signed bytes."""
        if (t := self.known.get(chunk)) is None:
            if len(self.known) > KNOWN_CHUNKS:
                self.known.clear()
            counts = self.chunk(chunk)
            t = counts[-1], array("b", map(sub, counts[1:], counts)).tobytes()
            if len(chunk) <= 64:
                self.known[chunk] = t
        return t

    def split(self, text: str) -> list[str]:
        """The chunks of a text, with the space that the library puts before it."""
        return self.chunks((SPACE + text).replace(" ", SPACE)) if text else []

    def changes(self, text: str) -> tuple[int, bytes]:
        """The count of the whole text, and what each character changes, the space before the text included."""
        known, n, parts = self.known, 0, []
        for c in self.split(text):
            t = known.get(c) or self.table(c)
            n += t[0]
            parts.append(t[1])
        return n, b"".join(parts)

    def total(self, text: str) -> int:
        """The count at the last prefix, the whole text."""
        return self.changes(text)[0]

    def prefix_counts(self, text: str) -> np.ndarray:
        """Counts at every prefix of 0, 1, ... characters of the text."""
        return counts_of(self.changes(text)[1])

    def fit(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most so many tokens."""
        return longest(self.prefix_counts(text), budget)


def counts_of(changes: bytes) -> np.ndarray:
    """Counts at every prefix of 0, 1, ... characters, from the stored changes."""
    out = np.frombuffer(changes, np.int8).cumsum(dtype=np.int64)
    if len(out):
        out[0] = 0  # the space put before the text is no character of it
        return out
    return np.zeros(1, np.int64)


def longest(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix within a budget."""
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


def store_prefixes(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and prefixes: by how much each character changes the count, a signed byte each.

    Null texts count as empty: no byte, no token, no change. Equal rows give equal rows, an empty table an empty one,
    and further columns are not read. Texts of any length are counted whole. Budgets and truncation read the stored
    changes, not the texts.
    """

    def make():
        counter = PrefixCounter.load(model_path)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = common.texts_of(b)
            n, changes = zip(*map(counter.changes, texts), strict=True)
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(changes, pa.binary())], ["doc_id", "n_bytes", "n_tokens", "prefixes"])

        return run

    docs = common.spread(common.id_and_text(docs, id_col, text_col))
    return common.map_batches(docs, make, "doc_id long, n_bytes long, n_tokens long, prefixes binary")


def truncate(stored: DataFrame, budget: int) -> DataFrame:
    """The rows of store_prefixes without the changes, with over_limit and fit_chars, the characters of the longest prefix within the budget."""

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            n, changes = b.column("n_tokens").to_numpy(), b.column("prefixes")
            fit = [longest(counts_of(changes[i].as_py()), budget) if n[i] > budget else max(0, len(changes[i].as_buffer()) - 1) for i in range(len(n))]
            return pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(n > budget), pa.array(fit, pa.int64())], [*kept, "over_limit", "fit_chars"])

        return run

    kept = ["doc_id", "n_bytes", "n_tokens"]
    return common.map_batches(stored, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def budget_split(stored: DataFrame, budget: int) -> DataFrame:
    """doc_id, part, start and stop: characters of consecutive parts whose counts differ by at most the budget from start to stop.

    A part has one character at least, so a character of more tokens than the budget is a part of its own. Empty texts
    have no part.
    """
    if budget < 1:
        raise ValueError("a budget of at least one token")

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            for d, c in zip(b.column("doc_id").to_pylist(), b.column("prefixes").to_pylist(), strict=True):
                counts, at, k = counts_of(c), 0, 0
                while at < len(counts) - 1:
                    stop = at + max(1, _first_part(counts, at, budget))
                    out.append((d, k, at, stop))
                    at, k = stop, k + 1
            columns = list(zip(*out, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "part", "start", "stop"])

        return run

    return common.map_batches(stored.select("doc_id", "prefixes"), make, "doc_id long, part int, start long, stop long")


def _first_part(counts: np.ndarray, at: int, budget: int) -> int:
    """Characters from `at` to the last place, before the first that exceeds the budget for good, whose count is within it; looked for in growing reach."""
    reach = 8 * budget + 64
    while True:
        within = np.flatnonzero(counts[at : at + reach] - counts[at] <= budget)[-1]
        if at + reach >= len(counts) or within < reach // 2:
            return int(within)
        reach *= 2


def count_documents(docs: DataFrame, model_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars, the characters of the longest prefix within the limit, from the changes at every prefix."""
    return truncate(store_prefixes(docs, model_path, id_col, text_col), limit)
