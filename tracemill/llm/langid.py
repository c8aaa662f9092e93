"""Language identification in two steps: the family first, then one-versus-one linear SVMs within it.

Features are hashed counts of letter pairs and triples of the whole text. The classifiers are fitted on a bounded
sample of labelled rows (`per_language` texts of each language, chosen by a hash of the id); predictions read
nothing but the text.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import common

#: Families of closely related languages; a label that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sr": "slavic",
}
BITS = 11
UND = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Bytes that are no letters count as a space.
KEEP = np.where([chr(i).isascii() and not chr(i).isalpha() for i in range(128)] + [False] * 128, 32, np.arange(256)).astype(np.uint8)


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed pairs and triples, two blocks of length one."""
    x = KEEP[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)].astype(np.uint32)
    x = np.concatenate([[32], x, [32]]).astype(np.uint32)
    x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]  # runs of other characters count once
    out = np.empty(2 << BITS, np.float32)
    two = x[:-1] << 8 | x[1:]
    three = two[:-1] << 8 | x[2:]
    for k, grams in enumerate((two, three)):
        h = grams * np.uint32(2654435761) >> np.uint32(32 - BITS)
        c = np.bincount(h, minlength=1 << BITS).astype(np.float32)
        out[k << BITS : (k + 1) << BITS] = np.sqrt(c / max(c.sum(), 1))
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 30.0, rounds: int = 200) -> np.ndarray:
    """Weights with the intercept last: L2-regularized squared hinge loss, classes of equal weight, by accelerated gradient."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    cost = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32) * penalty
    w = v = np.zeros(x.shape[1], np.float32)
    step = 1 / (1 + 2 * float((cost * (x * x).sum(1)).sum()))
    for k in range(rounds):
        loss = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v - 2 * x.T @ (cost * loss * y))
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


@dataclass
class Model:
    families: list[str]
    family_w: np.ndarray  # a row for each family, against all others
    members: dict[str, list[str]]
    pair_w: dict[tuple[str, str], np.ndarray]  # positive: the first of the two

    @classmethod
    def fit(cls, x: np.ndarray, langs: list[str], families: dict[str, str] = FAMILIES) -> Model:
        of = np.array([families.get(a, a) for a in langs], object)
        langs_a, names = np.array(langs, object), sorted(set(of))
        family_w = np.array([linear_svm(x, np.where(of == f, 1, -1).astype(np.float32)) for f in names]).reshape(len(names), -1)
        members = {f: sorted(set(langs_a[of == f])) for f in names}
        pair_w = {}
        for f in names:
            for a, b in itertools.combinations(members[f], 2):
                rows = (langs_a == a) | (langs_a == b)
                pair_w[a, b] = linear_svm(x[rows], np.where(langs_a[rows] == a, 1, -1).astype(np.float32))
        return cls(names, family_w, members, pair_w)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.families:
            return [UND] * len(x), np.zeros(len(x))
        sure = lambda m: 1 / (1 + np.exp(-3 * np.clip(m.astype(np.float64), -50, 50)))
        x = x.astype(np.float64)
        # rounded, as the order of sums goes by how many rows are asked at once
        times = lambda rows, w: np.round(rows @ w[..., :-1].T + w[..., -1], 9)
        margin = times(x, self.family_w)
        best = margin.argmax(1)
        score = sure(margin[np.arange(len(x)), best]) if len(self.families) > 1 else np.ones(len(x))
        out = np.empty(len(x), object)
        for k, f in enumerate(self.families):
            rows, names = np.flatnonzero(best == k), self.members[f]
            votes, least = np.zeros((len(rows), len(names))), np.ones((len(rows), len(names)))
            for i, j in itertools.combinations(range(len(names)), 2):
                w = self.pair_w[names[i], names[j]]
                p = sure(times(x[rows], w))
                votes[:, i] += (p >= 0.5) + p / len(names) ** 2  # a vote for each duel won; margins settle ties
                votes[:, j] += (p < 0.5) + (1 - p) / len(names) ** 2
                least[:, i], least[:, j] = np.minimum(least[:, i], p), np.minimum(least[:, j], 1 - p)
            won = votes.argmax(1)
            out[rows] = np.array(names, object)[won]
            score[rows] *= least[np.arange(len(rows)), won]
        return list(out), score


def fit(docs: DataFrame, trained: F.Column, per_language: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits on at most per_language rows of each language among those where `trained` holds and text and language aren't null.

    Hashes of the ids choose the rows: a share that gives 0.9 of the bound on average, and no row beyond the bound.
    Without any labelled row the model answers `und`.
    """
    rows = docs.select(docs[id_col].cast("string").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"), trained.alias("on"))
    rows = rows.where("on and text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.empty((0, 0), np.float32), {}, {})
    space = 1 << 30
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, space if n <= per_language else int(space * 0.9 * per_language / n))])
    chosen = rows.where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(""))), F.lit(space)) < share[F.col("lang")])

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            x = [features(t).tobytes() for t in common.texts_of(b)]
            return pa.RecordBatch.from_arrays([b.column("lang"), pa.array(x, pa.binary())], ["lang", "x"])

        return run

    got = sorted((r["lang"], bytes(r["x"])) for r in common.map_batches(chosen.select("lang", "text"), make, "lang string, x binary").toLocalIterator())
    got = [r for _, group in itertools.groupby(got, key=lambda r: r[0]) for r in itertools.islice(group, per_language)]
    return Model.fit(np.frombuffer(b"".join(x for _, x in got), np.float32).reshape(len(got), -1), [a for a, _ in got])


def _predictor(model: Model):
    def predict(texts: list[str]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            a, s = model.predict(np.array([features(t) for t in part]))
            for t, lang, score in zip(part, a, s, strict=True):
                letters = LETTER.search(t) is not None
                langs.append(lang if letters else UND)
                scores.append(float(score) if letters else 0.0)
        return langs, scores

    return predict


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for every whole text. Null texts and texts without a letter are `und` with score 0; equal texts get equal answers; an empty table gives an empty one."""

    def make():
        predict = _predictor(model)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = predict(common.texts_of(b))
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

        return run

    return common.map_batches(common.spread(common.id_and_text(docs, id_col, text_col)), make, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language with at least this score."""

    def make():
        predict = _predictor(model)

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            langs, scores = predict(common.texts_of(b, text_col))
            return b.filter(pa.array([lang != UND and s >= least for lang, s in zip(langs, scores, strict=True)]))

        return run

    return common.map_batches(docs, make, docs.schema)
