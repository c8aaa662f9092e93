"""Scoring of texts by a small causal self-attention model, trained and run in numpy on subword ids.

A text is its words, then an end token; the words, joined by blanks, become subword ids of a public byte-level
vocabulary, once, in a written table. The text is covered by overlapping windows: each half window of targets attends
to itself, causally, and to the half before, so every token is scored once with at least half a window behind it.
Counts of all pairs of neighbours in the training texts say which class of ids follows an id, and which id of that
class; attention over the window moves the classes from there. Word counts, subword counts, pairs and the base score
cover all training texts, and the attention weights descend on every window of every training text.

Each training text belongs to a round and a group by a hash of its id and its subwords. In a round every group
descends from the same weights, in an order that the hash fixes, and the weights are averaged. So the model does not
depend on how the table is dealt to tasks.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import common

HALF = 16
WIDE = 2 * HALF
#: The end token among words: no word holds white space.
END = b"\n"
#: Longer words are encoded in parts of so many characters.
LONG = 256
#: The most frequent words, sent to all tasks; counts of the others are joined. A bound on that broadcast, not on the result.
HOT = 1 << 17
#: Cells of a table, and rows of the embedding, that tasks hand on together.
CELLS, EMBEDDED = 4096, 256
#: Windows a task holds and shuffles before it descends on them.
HELD = 1 << 14
#: Texts whose windows are made together.
TEXTS = 64
#: Windows worked out together, few enough that their arrays stay in the cache. Always as many, so that rounding does not depend on a text's neighbours.
TOGETHER = 16
#: Half windows that are scored at once.
SCORED = 32


@dataclass(frozen=True)
class Settings:
    dim: int = 24
    classes: int = 64
    embedded: int = 2048  # ids with an embedding and pair counts of their own; the others share `buckets`
    buckets: int = 256
    steps: int = 2400  # of descent by each group at least, by repeated passes if need be; all windows are used at least once
    rounds: int = 4  # each text is in one; after each the groups' weights are averaged
    batch: int = 128  # windows; a multiple of TOGETHER
    rate: float = 0.015
    prior: float = 5.0  # pairs that the counts alone stand for
    seed: int = 3


def words_of(text: str) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z in lower case, then the end token."""
    out = text.encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


@functools.lru_cache(maxsize=1)
def _encoding(ranks_path: str) -> tiktoken.Encoding:
    """Each word, with the blank before it, is merged by itself."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("subwords", pat_str=" [^ ]+", mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def _begins(ranks_path: str) -> np.ndarray:
    """Which ids begin with a blank, so a word or a part of one."""
    encoding = _encoding(ranks_path)
    out = np.zeros(encoding.max_token_value + 2, bool)
    out[[encoding.encode_single_token(t) for t in encoding.token_byte_values() if t[:1] == b" "]] = True
    return out


class Subwords:
    """Subword ids of a text's words."""

    def __init__(self, ranks_path: str):
        self.encoding = _encoding(ranks_path)
        self.size = self.encoding.max_token_value + 2
        self.end = self.size - 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.begins = _begins(ranks_path)

    def pool(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and where each word's begin and the last one's end."""
        if not words:
            return np.empty(0, self.dtype), np.zeros(1, np.int64)
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        parts = np.ones(len(words), np.int64)
        if long:
            words = list(words)
            for i in long:
                cut = [words[i][at : at + LONG] for at in range(0, len(words[i]), LONG)]
                parts[i], words[i] = len(cut), " ".join(cut)
        ids = self.encoding.encode_to_numpy(" " + " ".join(words), disallowed_special=()).astype(self.dtype)
        first = np.append(np.flatnonzero(self.begins[ids]), len(ids))
        return ids, first[np.concatenate([[0], parts.cumsum()])]

    def ids_of(self, words: list[bytes]) -> np.ndarray:
        """Of words that end with the end token."""
        return np.append(self.pool([w.decode("utf-8", "replace") for w in words[:-1]])[0], np.array(self.end, self.dtype))


def _words_in(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What words_of gives for all texts of a batch: the different words, the end token last; which of them stand in the texts, one text after the other; how many each text has."""
    texts = pc.fill_null(batch.column("text"), "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = parts.flatten().dictionary_encode()
    words, codes = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
    ends = np.cumsum(pc.list_value_length(parts).to_numpy())
    blank = pc.index(words, "").as_py()  # before, between or behind white space
    kept = codes != blank
    n = np.diff(np.concatenate([[0], kept.cumsum()])[ends], prepend=0)
    if blank >= 0:
        words, codes = pa.concat_arrays([words[:blank], words[blank + 1 :]]), codes[kept]
        codes -= codes > blank
    return pa.concat_arrays([words, pa.array([END.decode()], words.type)]), np.insert(codes, n.cumsum(), len(words)), n + 1


def _ids_in(batch: pa.RecordBatch, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts of a batch in a row, and how many each has."""
    column = batch.column("ids").cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(dtype) if data else np.empty(0, dtype)
    return flat.astype(np.int64), np.diff(offsets).astype(np.int64) // dtype.itemsize


def windows(ids: np.ndarray, lengths: np.ndarray, bos: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (WIDE), targets (HALF wide, -1 for none), text of each window, and windows with nothing before their targets' half, for texts of these many ids in a row."""
    inputs, targets, blocks, first = _blocks(ids, lengths, bos, pad)
    text = np.repeat(np.arange(len(lengths)), blocks)
    k = np.arange(len(text)) + text + 1  # each text has an empty block before it
    return np.hstack([inputs[k - 1], inputs[k]]), targets[k], text, first - np.arange(len(lengths))


def _blocks(ids: np.ndarray, lengths: np.ndarray, bos: int, pad: int, even: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets in blocks of HALF, an empty one before each text; blocks of each text and where its empty one is. With even, a text has an odd number of blocks beside the empty one."""
    blocks = -(-lengths // HALF)
    if even:
        blocks += 1 - blocks % 2
    first = blocks.cumsum() - blocks + np.arange(len(lengths))
    total = int(blocks.sum()) + len(lengths)
    inputs, targets = np.full(total * HALF + 1, pad, np.int64), np.full(total * HALF, -1, np.int64)
    starts = (first + 1) * HALF
    at = np.repeat(starts - (lengths.cumsum() - lengths), lengths) + np.arange(len(ids))
    targets[at] = ids
    inputs[at + 1] = ids
    inputs[starts + lengths] = pad
    inputs[starts] = bos
    return inputs[:-1].reshape(-1, HALF), targets.reshape(-1, HALF), blocks, first


def whole(ids: np.ndarray, lengths: np.ndarray, bos: int, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows to learn from: WIDE inputs and targets, each token a target once, and which windows begin with a text's empty block."""
    inputs, targets, blocks, first = _blocks(ids, lengths, bos, pad, even=True)
    starts = np.zeros(len(inputs) // 2, bool)
    starts[first // 2] = True
    return inputs.reshape(-1, WIDE), targets.reshape(-1, WIDE), starts


def blocks_of(inputs: np.ndarray, lengths: np.ndarray, pad: int, several: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's inputs in blocks of HALF of its own, behind one that is no text's; where each input is; which block begins a text that isn't empty, the first not counted. There are as many blocks beside the first as a multiple of several."""
    blocks = -(-lengths // HALF)
    first = blocks.cumsum() - blocks
    total = -(-int(blocks.sum()) // several) * several
    out = np.full((total + 1) * HALF, pad, inputs.dtype)
    at = np.repeat((first + 1) * HALF - (lengths.cumsum() - lengths), lengths) + np.arange(len(inputs))
    out[at] = inputs
    return out, at, first[lengths > 0]


def _before(ids: np.ndarray, lengths: np.ndarray, bos: int) -> np.ndarray:
    """The id before each, or the start of a text."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[(lengths.cumsum() - lengths)[lengths > 0]] = bos
    return out


CAUSAL = np.tril(np.ones((WIDE, WIDE), np.float32))


class AttentionLM:
    def __init__(self, counts: np.ndarray, settings: Settings):
        """counts: of each subword id in the training texts, all of them."""
        self.s, size = settings, len(counts)
        top = np.argsort(-counts, kind="stable")[: settings.embedded]
        top = top[counts[top] > 0]
        self.counts, self.top, n = counts, top, len(top)
        self.row = (n + np.arange(size + 2) % settings.buckets).astype(np.int64)
        self.row[top] = np.arange(n)
        self.rows = n + settings.buckets + 2
        self.bos, self.pad = size, size + 1
        self.row[size:] = self.rows - 2, self.rows - 1
        self.column = np.full(size, n, np.int64)  # ids without pair counts of their own share the last one
        self.column[top] = np.arange(n)
        self.columns = n + 1
        mass = counts + 1.0
        self.share = np.bincount(self.column, weights=mass, minlength=self.columns)
        self.own = np.where(self.column == n, np.log(mass / self.share[-1]), 0).astype(np.float32)
        self.label = np.full(self.columns, settings.classes - 1, np.int64)
        self.params: dict[str, np.ndarray] = {}

    def paired(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Cells of a table of rows x columns: the id before, the start of a text included, and the id."""
        return self.row[_before(ids, lengths, self.bos)] * self.columns + self.column[ids]

    def count(self, pairs: np.ndarray) -> None:
        """Classes and the tables that follow from the counts of all pairs."""
        pairs = pairs.reshape(self.rows, self.columns).astype(np.float32)
        self._cluster(pairs)
        c, prior, share = self.s.classes, self.s.prior, self.share.astype(np.float32)
        by_class = np.zeros((c, self.rows), np.float32)
        np.add.at(by_class, self.label, pairs.T)
        of_class = np.bincount(self.label, weights=share, minlength=c).astype(np.float32)
        follow = by_class.T + prior * np.maximum(of_class, 1e-3) / of_class.sum()
        self.follow = np.ascontiguousarray(np.log(follow / follow.sum(1, keepdims=True)), np.float32)
        alone = share / of_class[self.label]
        self.within = np.log((pairs + prior * alone) / (by_class.T[:, self.label] + prior)).astype(np.float32)

    def _cluster(self, pairs: np.ndarray) -> None:
        """Classes of ids that follow similar ids and stand before similar ones, by k-means."""
        c, n = self.s.classes - 1, len(self.top)
        if n <= c:
            self.label[:n] = np.arange(n)
            return
        rng = np.random.default_rng(self.s.seed)
        weight = np.sqrt(pairs[:, :n].sum(0))
        sides = [pairs[:, :n].T, pairs[:n]]
        x = np.hstack([np.sqrt(z / np.maximum(z.sum(1, keepdims=True), 1)) for z in sides])
        centers = x[rng.choice(n, c, replace=False, p=weight / weight.sum() if (weight > 0).sum() >= c else None)]
        for _ in range(12):
            label = (x @ centers.T - (centers * centers).sum(1) / 2).argmax(1)
            for k in range(c):
                rows = label == k
                if weight[rows].sum():
                    centers[k] = np.average(x[rows], axis=0, weights=weight[rows])
        self.label[:n] = label

    def start(self) -> None:
        """The weights before any descent: the classes are those of the pair counts."""
        rng, d = np.random.default_rng(self.s.seed), self.s.dim
        w = lambda *shape, scale=1.0: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.params = {"e": w(self.rows, d, scale=0.5), "p": w(WIDE, d, scale=0.2), "w": w(d, 4 * d, scale=d**-0.5), "b": np.zeros(d, np.float32), "o": w(d, self.s.classes, scale=0.01), "c": np.zeros(self.s.classes, np.float32)}
        self.params["w"][:, :d] *= d**-0.5

    def fit(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        """What _fit does over a table, on texts at hand."""
        self.count(np.bincount(self.paired(ids, lengths), minlength=self.rows * self.columns))
        self.start()
        x, y, starts = whole(ids, lengths, self.bos, self.pad)
        if len(x):
            descent, passes = Descent(self), -(-self.s.steps * self.s.batch // len(x))
            descent.run(x, y, starts, passes, lambda done: done / (passes * len(x)))

    def ready(self) -> Scorer:
        return Scorer(self)


class Gradients:
    """Of the summed loss over TOGETHER windows at a time, in arrays that are used again."""

    def __init__(self, lm: AttentionLM, dtype: type = np.float32):
        d, n, c = lm.s.dim, TOGETHER, lm.s.classes
        room = lambda *shape: np.empty(shape, dtype)
        self.x, self.met, self.h, self.dh, self.scaled = (room(n, WIDE, d) for _ in range(5))
        self.z, self.dz, self.turned = room(n, WIDE, 4 * d), room(n, WIDE, 4 * d), room(n, d, WIDE)
        self.a, self.da, self.causal = room(n, WIDE, WIDE), room(n, WIDE, WIDE), np.tile(CAUSAL, (n, 1, 1)).astype(dtype)
        self.l, self.follow, self.at = room(n * WIDE, c), room(n * WIDE, c), np.arange(n * WIDE) * c
        self.ones, self.wide, self.each, self.row = np.ones(c, dtype), np.ones(WIDE, dtype), np.ones(d, dtype), np.ones(n * WIDE, dtype)

    def add(self, rows: np.ndarray, labels: np.ndarray, ok: np.ndarray, starts: np.ndarray, at: Batch, dx: np.ndarray, out: dict[str, np.ndarray]) -> None:
        """rows: of what the batch has of the embedding, for each place; labels: classes, of the targets where ok is 1. dx takes the gradient of each input."""
        x, a, l, da, met = self.x, self.a, self.l, self.da, self.met
        n, _, d = x.shape
        shaped = rows.reshape(n, WIDE)
        np.take(at.e, shaped, axis=0, out=x, mode="clip")
        x += at.p
        # in halves, that are small enough for the library's short way
        x2, z, dz = (y.reshape(2, n // 2 * WIDE, -1) for y in (x, self.z, self.dz))
        np.matmul(x2, at.w, out=z)
        q, k, v, own = (self.z[:, :, i * d : (i + 1) * d] for i in range(4))
        np.copyto(self.turned, k.transpose(0, 2, 1))
        np.matmul(q, self.turned, out=a)
        np.clip(a, -20, 20, out=a)
        np.exp(a, out=a)
        a *= self.causal
        a[starts, HALF:, :HALF] = 0  # the empty block; its own places have no targets
        whole = (1 / (a @ self.wide))[:, :, None]
        np.matmul(a, v, out=met)
        met *= whole
        np.add(met, own, out=self.h)
        self.h += at.b
        h = self.h.reshape(-1, d)
        np.tanh(h, out=h)
        np.matmul(h, at.o, out=l)
        np.take(at.follow, rows, axis=0, out=self.follow, mode="clip")
        l += self.follow
        np.exp(l, out=l)
        total = l @ self.ones
        l.reshape(-1)[self.at + labels] -= total
        share = ok / total
        l *= share[:, None]
        out["o"] += h.T @ l
        out["c"] += self.row @ l
        dh = self.dh.reshape(-1, d)
        np.matmul(l, at.turned, out=dh)
        h *= h
        np.subtract(1, h, out=h)
        dh *= h
        # a, divided by its sums, has weights; what they sum to times dh is taken off
        np.multiply(self.dh, whole, out=self.scaled)
        met *= self.scaled
        off = met @ self.each
        np.copyto(self.turned, v.transpose(0, 2, 1))
        np.matmul(self.scaled, self.turned, out=da)
        da -= off[:, :, None]
        da *= a
        dq, dk, dv = (self.dz[:, :, i * d : (i + 1) * d] for i in range(3))
        np.matmul(da, k, out=dq)
        np.matmul(da.transpose(0, 2, 1), q, out=dk)
        np.matmul(a.transpose(0, 2, 1), self.scaled, out=dv)
        self.dz[:, :, 3 * d :] = self.dh
        np.matmul(dz, at.back, out=dx.reshape(2, -1, d))
        out["w"] += x2[0].T @ dz[0]
        out["w"] += x2[1].T @ dz[1]
        out["b"] += self.row @ self.dh.reshape(-1, d)
        out["p"] += dx.reshape(n, WIDE, d).sum(0)


@dataclass
class Batch:
    """What a batch needs of the weights."""

    e: np.ndarray  # rows of the embedding, and below of what follows them, that it has
    follow: np.ndarray
    p: np.ndarray
    w: np.ndarray
    back: np.ndarray  # w's transpose
    b: np.ndarray
    o: np.ndarray
    turned: np.ndarray  # o's transpose


class Descent:
    """Steps of Adam on a model's weights."""

    def __init__(self, lm: AttentionLM, seed: int = 0):
        self.lm, self.rng, self.t, self.done = lm, np.random.default_rng((lm.s.seed, seed)), 0, 0
        kind = lm.params["e"].dtype
        self.names = [k for k in lm.params if k != "e"]
        # all weights but the embedding lie in one array, so that they move at once
        self.flat = np.concatenate([lm.params[k].ravel() for k in self.names])
        lm.params = {"e": lm.params["e"]} | self._views(self.flat)
        self.m, self.v = ({"e": np.zeros_like(lm.params["e"]), "": np.zeros_like(self.flat)} for _ in range(2))
        self.work, self.dx = Gradients(lm, kind), np.empty((-(-lm.s.batch // TOGETHER) * TOGETHER * WIDE, lm.s.dim), kind)
        self.met = np.zeros(lm.rows)  # how often each row of the embedding was met

    def _views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k in self.names:
            x = self.lm.params[k]
            out[k] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        return out

    def gradients(self, rows: np.ndarray, targets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Of the mean loss over a batch of windows or less; that of the embedding for the rows in them, which come first."""
        met, e, flat = self._gradients(rows, targets, starts)
        return met, {"e": e} | self._views(flat)

    def _gradients(self, rows: np.ndarray, targets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, d = self.lm.params, self.lm.s.dim
        flat = np.zeros_like(self.flat)
        g = self._views(flat)
        n = len(rows)
        if n % TOGETHER:
            more = TOGETHER - n % TOGETHER
            rows, targets, starts = np.pad(rows, ((0, more), (0, 0)), constant_values=self.lm.rows - 1), np.pad(targets, ((0, more), (0, 0)), constant_values=-1), np.pad(starts, (0, more))
        each = rows.ravel()
        here = np.zeros(self.lm.rows, bool)
        here[each] = True
        met = np.flatnonzero(here)
        place = (here.cumsum() - 1).take(each)
        t = targets.ravel()
        ok = (t >= 0).astype(flat.dtype)
        labels = self.lm.label.take(np.maximum(t, 0))
        at = Batch(p["e"].take(met, 0), self.lm.follow.take(met, 0) + p["c"], p["p"], p["w"], np.ascontiguousarray(p["w"].T), p["b"], p["o"], np.ascontiguousarray(p["o"].T))
        dx = self.dx[: len(each)]
        for low in range(0, len(rows), TOGETHER):
            part = slice(low * WIDE, (low + TOGETHER) * WIDE)
            self.work.add(place[part], labels[part], ok[part], starts[low : low + TOGETHER], at, dx[part], g)
        total = max(1, int(ok.sum()))
        flat /= total
        of_e = np.empty((len(met), d), flat.dtype)
        for i, x in enumerate(dx.T.astype(np.float64)):
            of_e[:, i] = np.bincount(place, weights=x, minlength=len(met))
        of_e /= total
        return met, of_e, flat

    def run(self, inputs: np.ndarray, targets: np.ndarray, starts: np.ndarray, passes: int, progress: Callable[[int], float]) -> None:
        """Each window once in each pass; progress tells from the windows done how far the whole descent is."""
        s, e, m, v = self.lm.s, self.lm.params["e"], self.m, self.v
        rows, columns = self.lm.row[inputs], np.where(targets >= 0, self.lm.column[targets], -1)
        self.met += np.bincount(rows.ravel(), minlength=len(self.met))
        for _ in range(passes):
            order = self.rng.permutation(len(rows))
            for at in range(0, len(rows), s.batch):
                part = order[at : at + s.batch]
                self.t += 1
                rate = (s.rate * (1 - min(1.0, progress(self.done))) + 1e-4) * min(1, len(part) / s.batch)
                self.done += len(part)
                met, of_e, rest = self._gradients(rows[part], columns[part], starts[part])
                self.flat -= self._step(m[""], v[""], rest, rate)
                # rows of the embedding move when they are met
                mk, vk = m["e"].take(met, 0), v["e"].take(met, 0)
                moved = e.take(met, 0)
                moved -= self._step(mk, vk, of_e, rate)
                m["e"][met], v["e"][met], e[met] = mk, vk, moved

    def _step(self, m: np.ndarray, v: np.ndarray, g: np.ndarray, rate: float) -> np.ndarray:
        """How far the weights go, with the means m and v moved by their gradient, which is used up."""
        m *= 0.9
        v *= 0.99
        step = g * 0.1
        m += step
        g *= g
        g *= 0.01
        v += g
        np.sqrt(v, out=step)
        step *= (1 - 0.99**self.t) ** -0.5
        step += 1e-8
        np.divide(m, step, out=step)
        step *= rate / (1 - 0.9**self.t)
        return step


class Scorer:
    """Log10 probabilities with all products of the embeddings worked out beforehand."""

    def __init__(self, lm: AttentionLM):
        p, d = lm.params, lm.s.dim
        self.row, self.bos, self.pad, self.last = lm.row, lm.bos, lm.pad, lm.rows - 1
        q, k, v, s = (p["w"][:, i * d : (i + 1) * d] for i in range(4))
        e, pos = p["e"], p["p"]
        self.tables = [np.ascontiguousarray(z, np.float32) for z in (e @ k, e @ v, e @ q, e @ s)]
        self.places = [np.ascontiguousarray(z, np.float32) for z in ((pos @ k).T, pos @ v, pos[HALF:] @ q, pos[HALF:] @ s + p["b"])]
        self.o, self.follow = p["o"].astype(np.float32), (lm.follow + p["c"]).astype(np.float32)
        self.within, self.own, self.label, self.column = lm.within.ravel(), lm.own, lm.label, lm.column
        self.columns, self.d = lm.columns, d

    def score(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of each text the sum over its ids."""
        d, n, c = self.d, SCORED, self.follow.shape[1]
        inputs, at, first = blocks_of(self.row[_before(ids, lengths, self.bos)], lengths, self.last, n)
        column = self.column[ids]
        # places of the blocks' targets; the block before the first is no text's
        at -= HALF
        label = np.zeros(len(inputs) - HALF, np.int64)
        label[at] = self.label[column]
        of_class = np.empty(len(label), np.float32)
        starts = np.zeros(len(label) // HALF, bool)
        starts[first] = True
        room = lambda *shape: np.empty(shape, np.float32)
        k, v, kt = room((n + 1) * HALF, d), room((n + 1) * HALF, d), room(d, (n + 1) * HALF)
        q, own, h, a, of_place, met = room(n, HALF, d), room(n, HALF, d), room(n, HALF, d), room(n, HALF, WIDE), room(n * HALF, WIDE), room(n * HALF, d)
        logits, follow, ones, wide, cells = room(n * HALF, c), room(n * HALF, c), np.ones(c, np.float32), np.ones(WIDE, np.float32), np.arange(n * HALF) * c
        # each block's keys and values, seen with those of the one before it
        keys = np.lib.stride_tricks.as_strided(kt, (n, d, WIDE), (HALF * kt.itemsize, *kt.strides))
        values = np.lib.stride_tricks.as_strided(v, (n, WIDE, d), (HALF * v.strides[0], *v.strides))
        causal = np.tile(CAUSAL[HALF:], (n, 1, 1))
        for low in range(0, len(label), n * HALF):
            r = inputs[low : low + (n + 1) * HALF]
            now = r[HALF:].reshape(n, HALF)
            for z, table, which in zip((k, v, q, own), self.tables, (r, r, now, now), strict=True):
                np.take(table, which, axis=0, out=z, mode="clip")
            np.copyto(kt, k.T)
            q += self.places[2]
            np.matmul(q, keys, out=a)
            np.matmul(q.reshape(-1, d), self.places[0], out=of_place)
            a += of_place.reshape(a.shape)
            np.clip(a, -20, 20, out=a)
            np.exp(a, out=a)
            a *= causal
            a[starts[low // HALF : low // HALF + n], :, :HALF] = 0
            np.matmul(a, values, out=h)
            np.matmul(a.reshape(-1, WIDE), self.places[1], out=met)
            h += met.reshape(h.shape)
            h /= (a @ wide)[:, :, None]
            h += own
            h += self.places[3]
            np.tanh(h, out=h)
            np.matmul(h.reshape(-1, d), self.o, out=logits)
            np.take(self.follow, r[HALF:], axis=0, out=follow, mode="clip")
            logits += follow
            got = logits.reshape(-1).take(cells + label[low : low + n * HALF])
            np.exp(logits, out=logits)
            got -= np.log(logits @ ones)
            of_class[low : low + n * HALF] = got
        log_p = self.within.take(inputs[at + HALF] * self.columns + column).astype(np.float64)
        log_p += self.own[ids]
        log_p += of_class[at]
        return np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=log_p, minlength=len(lengths)) / np.log(10)


def _word_counts(train: DataFrame) -> DataFrame:
    def count(batches):
        held, rows = [], 0
        for b in batches:
            words, codes, _ = _words_in(b)
            n = np.bincount(codes, minlength=len(words))
            some = np.flatnonzero(n)
            held.append(pa.table({"word": words.take(pa.array(some)).cast(pa.binary()), "n": n[some]}))
            rows += len(some)
            if rows > 400_000:
                held = [pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["word", "n"]).combine_chunks()]
                rows = held[0].num_rows
                if rows > 200_000:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        for t in held:
            yield from t.to_batches()

    return train.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _encoded(rows: DataFrame, hot: dict[str, int], ranks_path: str) -> DataFrame:
    """Of each row the subword ids, how many words it has, how many of them are hot, the sum of their logarithms, and the other words with their counts."""
    logs = np.log10(np.array(list(hot.values()), np.float64) + 1)
    shared = rows.sparkSession.sparkContext.broadcast((pa.array(list(hot), pa.string()), logs, *Subwords(ranks_path).pool(list(hot))))

    def make():
        sub = Subwords(ranks_path)
        hot_words, hot_logs, hot_pool, hot_starts = shared.value

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            words, codes, n = _words_in(b)
            starts = n.cumsum() - n
            end = len(words) - 1
            which = pc.fill_null(pc.index_in(words, hot_words), -1).to_numpy()
            is_cold = which < 0
            # the end token, cold or hot, has one id
            apart = np.flatnonzero(is_cold[:-1])
            cold_pool, cold_starts = sub.pool(words.take(pa.array(apart)).to_pylist())
            pool = np.concatenate([hot_pool, cold_pool, np.array([sub.end], sub.dtype)])
            begin, size = np.empty(end + 1, np.int64), np.empty(end + 1, np.int64)
            warm = np.flatnonzero(~is_cold[:-1])
            begin[warm], size[warm] = hot_starts[which[warm]], np.diff(hot_starts)[which[warm]]
            begin[apart], size[apart] = len(hot_pool) + cold_starts[:-1], np.diff(cold_starts)
            begin[end], size[end] = len(pool) - 1, 1
            sizes = size[codes]
            ends = sizes.cumsum()
            ids = pool[np.repeat(begin[codes] - (ends - sizes), sizes) + np.arange(ends[-1])]
            n_ids = np.add.reduceat(sizes, starts)
            logs = np.where(is_cold, 0.0, hot_logs[which] if len(hot_logs) else 0.0)
            cold_at = is_cold[codes]
            pairs, times = np.unique(np.repeat(np.arange(len(n)), n)[cold_at] * (end + 1) + codes[cold_at], return_counts=True)
            cold = pa.StructArray.from_arrays([words.take(pa.array(pairs % (end + 1))).cast(pa.binary()), pa.array(times, pa.int64())], ["word", "n"])
            offsets = np.searchsorted(pairs // (end + 1), np.arange(len(n) + 1)).astype(np.int32)
            bytes_at = np.concatenate([[0], n_ids.cumsum()]).astype(np.int32) * np.int32(sub.dtype.itemsize)
            blobs = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bytes_at), pa.py_buffer(ids)])
            columns = [pa.array(n), pa.array(np.add.reduceat((~is_cold)[codes], starts, dtype=np.int64)), pa.array(np.add.reduceat(logs[codes], starts)), pa.ListArray.from_arrays(pa.array(offsets), cold), pa.array(n_ids), blobs]
            return pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "row", "on")), *columns], ["doc_id", "row", "on", "n_tokens", "hot", "hot_log", "cold", "n_ids", "ids"])

        return run

    return common.map_batches(rows, make, "doc_id long, row long, on boolean, n_tokens long, hot long, hot_log double, cold array<struct<word: binary, n: long>>, n_ids long, ids binary")


def _subword_counts(train: DataFrame, size: int, dtype: np.dtype) -> np.ndarray:
    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(_ids_in(b, dtype)[0], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for r in train.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary
        out[r["id"]] = r["n"]
    return out


def _pair_counts(train: DataFrame, lm: AttentionLM, dtype: np.dtype) -> np.ndarray:
    """How often each id, or group of rare ones, follows each other in all training texts."""
    shared, size = train.sparkSession.sparkContext.broadcast(lm), lm.rows * lm.columns

    def count(batches):
        lm, total = shared.value, np.zeros(-(-size // CELLS) * CELLS, np.int64)
        for b in batches:
            np.add.at(total, lm.paired(*_ids_in(b, dtype)), 1)
        for k in np.flatnonzero(total.reshape(-1, CELLS).any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([zlib.compress(total[k * CELLS : (k + 1) * CELLS].tobytes(), 1)], pa.binary())], ["k", "n"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, n in zip(b.column("k").to_pylist(), b.column("n").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(zlib.decompress(n), np.int64)
        for k, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([zlib.compress(n.tobytes(), 1)], pa.binary())], ["k", "n"])

    out = np.zeros(-(-size // CELLS) * CELLS, np.int64)
    for r in train.select("ids").mapInArrow(count, "k long, n binary").repartition("k").mapInArrow(add, "k long, n binary").collect():  # at most the cells
        out[r["k"] * CELLS : (r["k"] + 1) * CELLS] = np.frombuffer(zlib.decompress(r["n"]), np.int64)
    return out[:size]


def _fit(train: DataFrame, lm: AttentionLM, dtype: np.dtype) -> None:
    """Weights from all windows of all training texts."""
    s = lm.s
    about = train.agg(F.sum(F.ceil((F.col("n_ids") + HALF) / WIDE))).first()[0]  # windows
    if not about:
        return
    passes = -(-s.steps * s.batch // about)
    groups = max(1, about // (s.steps * s.batch))  # a group makes enough steps of its own
    each = max(1, about * passes // (groups * s.rounds))
    dealt = train.withColumn("h", F.xxhash64("doc_id", "ids"))
    dealt = dealt.withColumn("g", F.pmod(F.shiftright("h", 32), F.lit(groups))).where(F.col("h").isNotNull())
    for k in range(s.rounds):
        texts = dealt.where(F.pmod("h", F.lit(s.rounds)) == k).select("g", "h", "ids").repartition(groups, "g").sortWithinPartitions("g", "h")
        _round(texts.select("g", "ids"), lm, k, passes, each, dtype)


def _round(texts: DataFrame, lm: AttentionLM, k: int, passes: int, each: int, dtype: np.dtype) -> None:
    """Each group descends from the same weights on all windows of its texts; then the weights are averaged, by windows, and rows of the embedding by how often a group met them."""
    shared, d = texts.sparkSession.sparkContext.broadcast(lm), lm.s.dim
    others = [x for x in lm.params if x != "e"]

    def descend(batches):
        lm = shared.value
        start = lm.params
        group, descent, held, seen, waiting = None, None, [], 0, 0

        def run():
            descent.run(*(np.concatenate(z) for z in zip(*held, strict=True)), passes, lambda done: (k + min(1.0, done / each)) / lm.s.rounds)
            held.clear()

        def finished():
            if held:
                run()
            p, lm.params = lm.params, start  # the worker may keep the broadcast model for another group
            e = np.hstack([p["e"], descent.met[:, None]]).astype(np.float32)
            rest = np.concatenate([*(p[x].ravel() for x in others), [seen]]).astype(np.float32)
            values = [rest, *(e[at : at + EMBEDDED] for at in range(0, len(e), EMBEDDED))]
            return pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int64()), pa.array([group] * len(values), pa.int64()), pa.array([v.tobytes() for v in values], pa.binary())], ["chunk", "g", "v"])

        for b in batches:
            of = b.column("g").to_numpy()
            for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1):
                if of[part[0]] != group:
                    if group is not None:
                        yield finished()
                    group, seen, waiting = int(of[part[0]]), 0, 0
                    lm.params = {x: v.copy() for x, v in start.items()}
                    descent = Descent(lm, group * lm.s.rounds + k)
                for low in range(part[0], part[-1] + 1, TEXTS):
                    ids, n = _ids_in(b.slice(low, min(TEXTS, part[-1] + 1 - low)), dtype)
                    x, y, starts = whole(ids, n, lm.bos, lm.pad)
                    ends = (-(-n // HALF) // 2 + 1).cumsum().tolist()
                    # a text's windows at a time, or HELD: what is held when the descent goes on depends on the texts alone
                    for first, end in zip([0, *ends[:-1]], ends, strict=True):
                        for i in range(first, end, HELD):
                            j = min(i + HELD, end)
                            held.append((x[i:j], y[i:j], starts[i:j]))
                            seen += j - i
                            waiting += j - i
                            if waiting >= HELD:
                                run()
                                waiting = 0
        if group is not None:
            yield finished()

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, v in zip(b.column("chunk").to_pylist(), b.column("v").to_pylist(), strict=True):
                v = np.frombuffer(v, np.float32).astype(np.float64).reshape(-1, d + 1) if chunk else np.frombuffer(v, np.float32).astype(np.float64)[None]
                v[:, :-1] *= v[:, -1:]
                total[chunk] = total.get(chunk, 0) + v
        for chunk, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([v.tobytes()], pa.binary())], ["chunk", "v"])

    summed = texts.mapInArrow(descend, "chunk long, g long, v binary").repartition("chunk").sortWithinPartitions("chunk", "g").mapInArrow(add, "chunk long, v binary")
    for r in summed.collect():  # the weights once
        v = np.frombuffer(r["v"], np.float64)
        if r["chunk"]:
            v, at = v.reshape(-1, d + 1), (r["chunk"] - 1) * EMBEDDED
            met = v[:, -1] > 0
            lm.params["e"][at : at + len(v)][met] = v[met, :-1] / v[met, -1:]
        else:
            v, at = v[:-1] / v[-1], 0
            for x in others:
                n = lm.params[x].size
                lm.params[x] = v[at : at + n].reshape(lm.params[x].shape).astype(np.float32)
                at += n


def _score(encoded: DataFrame, lm: AttentionLM, dtype: np.dtype) -> DataFrame:
    shared = encoded.sparkSession.sparkContext.broadcast(lm.ready())

    def make():
        scorer = shared.value

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            ids, n = _ids_in(b, dtype)
            # texts of some thousands of ids at a time, whose arrays stay in the cache
            ends = n.cumsum()
            cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + CELLS * 4, CELLS * 4)).clip(0, len(n)))
            parts = [scorer.score(ids[ends[i] - n[i] : ends[j - 1]], n[i:j]) for i, j in zip([0, *cuts[cuts > 0]], [*cuts[cuts > 0], len(n)], strict=True) if j > i]
            return pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(np.concatenate(parts))], [*kept, "score"])

        return run

    kept = ["doc_id", "row", "n_tokens", "hot", "hot_log"]
    return common.map_batches(encoded.select(*kept, "ids"), make, "doc_id long, row long, n_tokens long, hot long, hot_log double, score double")


def score_documents(docs: DataFrame, trained, ranks_path: str, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row; rows where `trained` holds are learned from.

    Null texts count as empty: just the end token. Equal texts get equal scores; rows with null or repeated ids are
    rows of their own. Without a training text every token is as likely as any other of its class and N is 0. An empty
    table gives an empty one; further columns are not read.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "lm")
    rows = common.spread(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.coalesce(trained, F.lit(False)).alias("on")))
    counts = scratch.write(_word_counts(rows.where("on")), "counts", "zstd")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    hot = {bytes(r["word"]).decode(): r["c"] for r in counts.orderBy(F.desc("c"), "word").limit(HOT).toLocalIterator()}
    encoded = scratch.write(_encoded(rows.withColumn("row", F.monotonically_increasing_id()), hot, ranks_path), "encoded", "zstd")
    sub = Subwords(ranks_path)
    train = encoded.where("on")
    lm = AttentionLM(_subword_counts(train, sub.size, sub.dtype), settings)
    lm.count(_pair_counts(train, lm, sub.dtype))
    lm.start()
    _fit(train, lm, sub.dtype)
    cold = encoded.select("row", F.inline("cold"))  # a word once for each row
    found = cold.join(counts, "word").groupBy("row").agg(F.sum("n").alias("cold_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("cold_log"))
    all_rows = _score(encoded, lm, sub.dtype).join(found, "row", "left")
    log_total = float(np.log10(totals["n"] + totals["v"] + 1))
    return all_rows.select(
        "doc_id", "n_tokens", (F.col("hot") + F.coalesce("cold_known", F.lit(0))).alias("n_known"), F.lit(totals["n"]).cast("long").alias("train_tokens"),
        (F.col("hot_log") + F.coalesce("cold_log", F.lit(0.0)) - F.col("n_tokens") * F.lit(log_total)).alias("base_score"), "score",
    )
