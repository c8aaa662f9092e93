"""Graph operators against plain walks, by the driver and by joins."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import graph, temporal


def reach_of(edges):
    after = {}
    for a, b, *_ in edges:
        after.setdefault(a, set()).add(b)
    out = {}
    for a in after:
        seen, ahead = set(), [a]
        while ahead:
            new = after.get(ahead.pop(), set()) - seen
            seen |= new
            ahead += new
        out[a] = seen
    return out


EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (6, 1), (7, 8), (5, 7), (2, 1)]


@pytest.mark.parametrize("at_hand", [1000, 0])
def test_components_and_rings(spark, monkeypatch, at_hand):
    monkeypatch.setattr(graph, "AT_HAND", at_hand)
    df = spark.createDataFrame(EDGES, "src long, dst long")
    reach = reach_of(EDGES)
    wanted = {n: min(m for m in reach[n] if n in reach.get(m, ())) for n in reach if n in reach[n]}
    assert {r.node: r.component for r in graph.cyclic(df).collect()} == wanted == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    assert {r.component: r.path for r in graph.shortest_cycle(df).collect()} == {1: [1, 2, 1], 4: [4, 5, 4], 6: [6, 6]}
    assert graph.cyclic(df.where("src > 6")).count() == graph.shortest_cycle(df.where("src > 6")).count() == 0


def test_consumers_and_redundant_links(spark):
    rng = random.Random(3)
    edges = sorted({(rng.randrange(12), rng.randrange(12), rng.choice(["PUBLIC", "PRIVATE", "INTERFACE"])) for _ in range(30)})
    df = spark.createDataFrame(edges, "src long, dst long, visibility string")
    open_reach = reach_of([e for e in edges if e[2] != "PRIVATE"])
    assert {(r.target, r.consumer) for r in graph.consumers(df).collect()} == {(t, a) for a, b, _ in edges for t in {b} | open_reach.get(b, set())}
    barrier = spark.createDataFrame([(5,)], "node long")
    got = {(r.src, r.dst): (r.hops, r.via) for r in graph.redundant(df, barriers=barrier).collect()}
    direct = {(a, b) for a, b, _ in edges if a != b}
    wanted = {}
    for a, via in direct:
        at, hops = {via}, 0
        seen = {via}
        while at and hops < 8:
            hops += 1
            at = {d for s, d, v in edges if s in at and v != "PRIVATE" and s != 5 and d != a} - seen
            seen |= at
            for b in at:
                if (a, b) in direct:
                    wanted[a, b] = min(wanted.get((a, b), (99, 99)), (hops, via))
    assert got == wanted and got


def test_ancestors_of_a_ring(spark):
    with pytest.raises(ValueError, match="own ancestor"):
        graph.ancestors(spark.createDataFrame([(1, 2), (2, 1)], "id long, parent_id long"))


def test_sequences_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(temporal, "WIDTH", 4)
    rng = random.Random(1)
    rows = [(r, o, rng.randrange(100)) for r in ("a", "b") for o in rng.sample(range(60), 25)]
    df = spark.createDataFrame(rows, "recording string, o long, t long")
    got = {(r.recording, r.o): (r.n, r.gap) for r in temporal.sequence(df, "o", ["recording"], F.col("t"), "n", "gap").collect()}
    one = {(r.recording, r.o): r.gap for r in temporal.self_time(df, F.col("t"), "o", ["recording"], "gap").collect()}
    for name in ("a", "b"):
        own = sorted((o, t) for r, o, t in rows if r == name)
        for i, (o, t) in enumerate(own):
            gap = max(0, own[i + 1][1] - t) if i + 1 < len(own) else 0
            assert got[name, o] == (i + 1, gap) and one[name, o] == gap
