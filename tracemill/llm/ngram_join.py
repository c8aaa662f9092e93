"""Exact Jaccard join of documents on word n-grams, as a blocked sparse product of documents and n-grams.

The product of the document by n-gram incidence with its transpose counts the n-grams that two documents share.
Shuffled by n-gram, its blocks add up partial counts; bounds from the sizes of the two sets discard pairs:

* sizes too far apart can't reach the threshold;
* n-grams of a prefix that no other prefix holds, and that stand before a shared one, are not shared: too many of
  them leave too few to share;
* a set's parity sketch has about as many bits as the set has n-grams, and each n-gram flips the bit of its hash; the
  bits in which two sketches differ are at most the n-grams in which the sets differ;
* a set whose prefix has fewer n-grams in lists than any link needs has no links;
* with n-grams in one global order, the rare ones first, two similar sets share at least so many n-grams in their
  first few (the prefix) as `needed` says. So only prefixes enter the product, and pairs below that count go.

Equal sets count once. N-grams held by the prefixes of the same documents are equal columns of the incidence and count
as one list with a weight, so a pair does not move once for each n-gram that it shares. Documents that share n-grams are first held against one leader of each list, in time linear
in the list; lists whose documents are then all in one component are done, so a group of near copies never spells
out its pairs. What is left is multiplied out in full. Every pair that passes the bounds is compared exactly on
whole sets before it counts as a link. How common n-grams are only sets their order: it changes no result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm import common

#: N-grams looked at together when common ones are sought, and in how many of their documents one must occur.
CHUNK = 2_000_000
COMMON = 6
#: The most common n-grams sent to all tasks: a bound on that broadcast, not on the result.
COMMON_MOST = 1 << 17
#: Candidate ids are broadcast up to this number; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
LEADER_ROUNDS = 3
#: Bits of the smallest parity sketch.
SKETCH_BITS = 512
#: What tells lists of different documents apart: the smallest and largest id, how many there are and two sums of hashes.
MEMBERS = ["low", "high", "members", "sum1", "sum2"]
COLUMNS = ["doc", "n", "pos", "own", "apart", "weight"]


@dataclass(frozen=True)
class Rule:
    """Links: den * intersection >= num * union, on distinct shingles of so many words."""

    words: int
    num: int
    den: int
    slack: int = 2  # percent of a set by which prefixes are longer than they must be; shared n-grams then count for more

    def least(self, n: Column | np.ndarray | int):
        """The intersection that a set of n needs with any partner."""
        return _up(n * self.num, self.den)

    def extra(self, n):
        return n * self.slack // 100 + 1 if not isinstance(n, Column) else F.floor(n * self.slack / 100).cast("long") + 1

    def needed(self, a: Column, b: Column) -> Column:
        """N-grams that the prefixes of two linked sets share at least."""
        both = _up((a + b) * self.num, self.den + self.num)
        return F.greatest(F.lit(1), F.least(both - self.least(a) + self.extra(a), both - self.least(b) + self.extra(b)))

    def fewest(self, n: Column) -> Column:
        """What `needed` is at least, whatever the partner."""
        return self.extra(F.floor(n * self.num / self.den))

    def may_link(self, x: str, y: str, sketch: bool = False) -> Column:
        """Whether the bounds let the documents of a row with columns x.n, y.n, ... be linked. own: n-grams known to be in one of the two sets only."""
        of = lambda side, c: F.col(f"{c}_{side}")
        a, b = of(x, "n"), of(y, "n")
        least = _up((a + b) * self.num, self.den + self.num)
        before = F.least(of(x, "pos") - of(x, "own"), of(y, "pos") - of(y, "own"))
        most = before + F.least(a - of(x, "pos"), b - of(y, "pos"))  # shared ones before this n-gram, and it and what follows
        out = self.sizes_fit(a, b) & (most >= least)
        return out & (_apart(of(x, "sketch"), of(y, "sketch")) <= a + b - 2 * least) if sketch else out

    def sizes_fit(self, a: Column, b: Column) -> Column:
        return F.least(a, b) * self.den >= F.greatest(a, b) * self.num


def _up(x, d: int):
    return F.ceil(x / d).cast("long") if isinstance(x, Column) else -(-x // d)


def _sketch(s: np.ndarray) -> np.ndarray:
    bits = max(SKETCH_BITS, 1 << (len(s) - 1).bit_length()) if len(s) else SKETCH_BITS
    odd = np.bincount((s >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _apart(x: Column, y: Column) -> Column:
    """Bits in which two sketches differ. One of twice the length is folded; 0 where lengths are further apart."""
    low, high = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    folded = lambda c: F.when(F.size(c) == low, c).otherwise(F.zip_with(F.slice(c, 1, low), F.slice(c, low + 1, low), lambda u, v: u.bitwiseXOR(v)))
    bits = F.aggregate(F.zip_with(folded(x), folded(y), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, v: t + v)
    return F.when(high > 2 * low, 0).otherwise(bits)


class _Hashes(dict):
    """64-bit hashes of words, kept while they fit."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = h
        return h


_HASHES = _Hashes()


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; with fewer words the whole sequence is one, without words there is none.

    Words are runs of bytes other than ASCII white space, A-Z in lower case.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, parts), np.uint64, len(parts))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out = np.sort(out * np.uint64(0xBF58476D1CE4E5B9))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def _common(docs: DataFrame, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """The most common n-grams, sorted, and their ranks: higher means more common."""

    def count(batches):
        held, n = [], 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            some = counts >= COMMON
            return pa.RecordBatch.from_arrays([pa.array(values[some].view(np.int64)), pa.array(counts[some].astype(np.int64))], ["shingle", "n"])

        for b in batches:
            for t in common.texts_of(b):
                held.append(shingles(t, rule.words))
                n += len(held[-1])
                if n >= CHUNK:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    counted = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "shingle").limit(COMMON_MOST).collect()
    values = np.array([r["shingle"] for r in rows], np.int64).view(np.uint64)
    ranks = np.log2(np.array([r["n"] for r in rows], np.float64)).astype(np.int64) + 1 if rows else np.empty(0, np.int64)
    order = np.argsort(values)
    return values[order], ranks[order]


def _list_array(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))


def _signatures(docs: DataFrame, rule: Rule, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n, two hashes of the whole set, the prefix and the sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def make():
        values, ranks = shared.value

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            n, h1, h2, prefixes, sketches = [], [], [], [], []
            for t in common.texts_of(b):
                s = shingles(t, rule.words)
                n.append(len(s))
                h1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                h2.append(int(((s ^ s >> np.uint64(31)) * np.uint64(0x94D049BB133111EB)).sum(dtype=np.uint64).view(np.int64)))
                sketches.append(_sketch(s))
                length = len(s) - rule.least(len(s)) + rule.extra(len(s)) if len(s) else 0
                if len(values) and len(s):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    rank = np.where(values[at] == s, ranks[at], 0)
                    if rank.any():
                        s = s[np.argsort(rank, kind="stable")]
                prefixes.append(s[:length].view(np.int64))
            arrays = [_list_array(prefixes), _list_array(sketches)]
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), *arrays], ["doc_id", "n", "h1", "h2", "prefix", "sketch"])

        return run

    return common.map_batches(docs, make, "doc_id long, n long, h1 long, h2 long, prefix array<long>, sketch array<long>")


def _verify(pairs: DataFrame, docs: DataFrame, rule: Rule, scratch: common.Scratch) -> DataFrame:
    """The pairs (a, b) that are links, by their whole sets. docs: the texts of a and b under those ids."""
    pairs = scratch.write(pairs, "pairs")
    ids = scratch.write(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    texts = scratch.write(texts, "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def make():
        last: list = [None, None]

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), common.texts_of(batch, "text_a"), common.texts_of(batch, "text_b"), strict=True):
                if last[0] != a:
                    last[:] = a, shingles(ta, rule.words)
                x, y = last[1], shingles(tb, rule.words)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(same > 0 and rule.den * same >= rule.num * (len(x) + len(y) - same))
            return batch.select(["a", "b"]).filter(pa.array(keep))

        return run

    links = scratch.write(common.map_batches(both.select("a", "b", "text_a", "text_b"), make, "a long, b long"), "links")
    scratch.drop(texts, pairs, ids)
    return links


def components(links: DataFrame, scratch: common.Scratch) -> DataFrame:
    """node and comp, the smallest id it reaches, of all nodes but those smallest ones: alternating large and small stars until nothing changes."""
    e = scratch.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if seen == tuple(state) or not state["n"]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        seen = tuple(state)
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.write(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        new = scratch.write(small.distinct(), "edges")
        scratch.drop(large, e)
        e = new


def _with_component(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))


def join(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, of every row.

    Null texts and texts without a word have the empty set and are linked with nothing. Rows that share an id are
    one document and should hold one text: of different texts each links to its equals, but only one of them is compared further. Rows with a null id are linked with nothing and have a null
    component. Equal texts with a word are linked. An empty table gives an empty one; further columns are not read.
    """
    scratch = common.Scratch(docs.sparkSession, "ngrams")
    docs = common.spread(common.id_and_text(docs, id_col, text_col))
    known = docs.where("doc_id is not null")
    signatures = scratch.write(_signatures(docs, rule, _common(docs, rule)), "signatures")
    small = signatures.where("n > 0 and doc_id is not null").select("doc_id", "n", "h1", "h2")
    # equal sets once, under their smallest id
    sets = small.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"))
    members = scratch.write(small.join(sets, ["h1", "h2", "n"]).select("doc_id", "n", "rep", "h1").distinct(), "members")
    reps = members.where("doc_id = rep").select("doc_id", "n", "h1")
    prefixes = signatures.join(reps, ["doc_id", "n", "h1"], "left_semi").select(F.col("doc_id").alias("doc"), F.posexplode("prefix").alias("pos", "shingle"))
    by_shingle, by_doc = Window.partitionBy("shingle"), Window.partitionBy("doc")
    part = lambda seed: F.sum(F.xxhash64("doc", F.lit(seed)).bitwiseAND(F.lit(0x7FFFFFFF))).over(by_shingle)
    held_by = {"low": F.min("doc").over(by_shingle), "high": F.max("doc").over(by_shingle), "members": F.count("*").over(by_shingle), "sum1": part(1), "sum2": part(2)}
    lists = prefixes.withColumns(held_by).where("low < high")
    # own: n-grams before this one that are in no list; apart: all of the prefix that are in none
    lists = lists.withColumns({"own": F.col("pos") - F.row_number().over(by_doc.orderBy("pos")) + 1, "listed": F.count("*").over(by_doc)})
    # sizes join only here: most n-grams are in one prefix and are gone
    sizes = signatures.join(reps, ["doc_id", "n", "h1"], "left_semi").select(F.col("doc_id").alias("doc"), "n", F.size("prefix").alias("length"), "sketch").dropDuplicates(["doc"])
    sizes = scratch.write(sizes, "sizes")
    lists = lists.join(sizes.drop("sketch"), "doc").where(F.col("listed") >= rule.fewest(F.col("n"))).withColumn("apart", F.col("length") - F.col("listed"))
    # equal lists once; of their n-grams the last one bounds best, and all prefixes have them in the same order
    lists = lists.groupBy(*MEMBERS, "doc").agg(F.max(F.struct("pos", "own", "n", "apart")).alias("last"), F.count("*").alias("weight"))
    lists = scratch.write(lists.select(F.xxhash64(*MEMBERS).alias("list"), "doc", "last.*", "weight").select("list", *COLUMNS), "lists")
    links = members.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    comps = None
    for turn in range(LEADER_ROUNDS):
        open_ = _open(lists, comps)
        # a text that others were copied from has the fewest n-grams of its own
        order = F.struct(F.col("apart").alias("first"), F.col("doc").alias("second"), *COLUMNS) if turn == 0 else F.struct(F.col("apart").alias("first"), F.xxhash64("doc", F.lit(turn)).alias("second"), *COLUMNS)
        leaders = open_.groupBy("list").agg(F.min(order).alias("lead")).select("list", *[F.col(f"lead.{c}").alias(f"{c}_lead") for c in COLUMNS])
        led = _side(open_, "doc").join(leaders, "list").where("doc_doc <> doc_lead").where(rule.may_link("doc", "lead"))
        counted = led.groupBy("doc_lead", "n_lead", "doc_doc", "n_doc").agg(F.sum(F.least("weight_doc", "weight_lead")).alias("same"))
        # half the count that all lists together must reach: these lists only show the n-grams that the leader leads
        likely = counted.where(F.col("same") * 2 >= rule.needed(F.col("n_doc"), F.col("n_lead"))).select(F.least("doc_lead", "doc_doc").alias("a"), F.greatest("doc_lead", "doc_doc").alias("b"))
        found = _verify(likely.distinct(), known, rule, scratch)
        links = links.union(found)
        comps = components(links, scratch)
    open_ = _open(lists, comps).withColumn("listed", F.sum("weight").over(by_doc)).where(F.col("listed") >= rule.fewest(F.col("n")))
    open_ = _open(open_.drop("comp"), comps)
    open_ = scratch.write(open_.join(sizes.select("doc", "sketch"), "doc"), "open")  # sketches move only with what is left
    product = _side(open_, "a").join(_side(open_, "b"), "list").where("doc_a < doc_b and comp_a <> comp_b").where(rule.may_link("a", "b", sketch=True))
    counted = product.groupBy("doc_a", "doc_b", "n_a", "n_b").agg(F.sum(F.least("weight_a", "weight_b")).alias("same"))
    found = _verify(counted.where(F.col("same") >= rule.needed(F.col("n_a"), F.col("n_b"))).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")), known, rule, scratch)
    comps = components(links.union(found), scratch)
    rows = signatures.select(F.col("doc_id").alias("doc"), F.col("n").alias("n_shingles"))
    return _with_component(rows, comps).select(F.col("doc").alias("doc_id"), "n_shingles", F.col("comp").alias("component_id"))


def _open(lists: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The lists whose documents aren't all in one component yet, with components."""
    if comps is None:
        return lists
    by_list = Window.partitionBy("list")
    rows = _with_component(lists, comps).withColumns({"low": F.min("comp").over(by_list), "high": F.max("comp").over(by_list)})
    return rows.where("low < high").select("list", *COLUMNS, "comp")


def _side(lists: DataFrame, name: str) -> DataFrame:
    return lists.select("list", *[F.col(c).alias(f"{c}_{name}") for c in lists.columns if c not in ("list", "apart")])


def keep_one(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all their columns, without those whose component has a smaller id. Of rows that share an id one stays; rows with a null id all stay."""
    classes = join(docs, rule, id_col, text_col)
    gone = classes.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    known = docs.where(docs[id_col].isNotNull()).dropDuplicates([id_col]).join(gone, id_col, "left_anti").select(*docs.columns)
    return known.unionByName(docs.where(docs[id_col].isNull()))
