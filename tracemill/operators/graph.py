"""Graph operators on edge tables (src, dst, visibility), by loops whose steps are joins.

Each step is written to a checkpoint where one is configured, so lineage stays short and lost executors cost one
step. Loops end when a step finds nothing new: nothing is left out beyond a number of steps, except where a bound is
a parameter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill import session

#: Edges that components and rings are looked for in by the driver; more are left to joins.
AT_HAND = 100_000


def closure(edges: DataFrame) -> DataFrame:
    """Pairs (src, dst) with a path of at least one edge. What a step found is joined with all found before, so paths double in length from step to step."""
    reach = session.dealt(session.cut(edges.select("src", "dst").distinct()))
    new = reach
    while True:
        step = new.select("src", F.col("dst").alias("via")).join(reach.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        new = session.dealt(session.cut(step.join(reach, ["src", "dst"], "left_anti")))
        if new.isEmpty():
            return reach
        reach = session.dealt(session.cut(reach.unionByName(new)))


def consumers(edges: DataFrame) -> DataFrame:
    """(target, consumer): all that link a target, and what links those that re-export it (visibility not PRIVATE)."""
    direct = edges.select(F.col("dst").alias("target"), F.col("src").alias("consumer")).distinct()
    handed = closure(edges.where("visibility <> 'PRIVATE'")).select(F.col("src").alias("via"), F.col("dst").alias("target"))
    return direct.unionByName(direct.withColumnRenamed("target", "via").join(handed, "via").select("target", "consumer")).distinct()


def simple_paths(edges: DataFrame, starts: DataFrame, goal, max_edges: int) -> DataFrame:
    """Paths of at most max_edges edges from starts (src) whose later hops aren't PRIVATE and that don't visit a node twice; a path ends at the goal."""
    onward = session.cut(edges.where("visibility <> 'PRIVATE'").select(F.col("src").alias("dst"), F.col("dst").alias("next")))
    paths = session.cut(starts.select("src").distinct().join(edges, "src").where(F.col("dst") != F.col("src")).select("src", "dst", F.array("src", "dst").alias("path")))
    out = paths.where(goal("dst"))
    for _ in range(max_edges - 1):
        paths = paths.where(~goal("dst")).join(onward, "dst").where(~F.array_contains("path", F.col("next")))
        paths = session.cut(paths.select("src", F.col("next").alias("dst"), F.array_append("path", F.col("next")).alias("path")))
        if paths.isEmpty():
            break
        out = out.unionByName(paths.where(goal("dst")))
    return out


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges left when nodes that nothing leads to, or that lead nowhere, are taken away again and again."""
    n = edges.count()
    while n:
        edges = session.cut(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        before, n = n, edges.count()
        if n == before:
            break
    return edges


def _at_hand(edges: DataFrame) -> dict | None:
    """Successors of each node, where the edges are few enough for the driver; else None."""
    rows = edges.limit(AT_HAND + 1).collect()
    if len(rows) > AT_HAND:
        return None
    out: dict = {}
    for src, dst in sorted(rows):
        out.setdefault(src, []).append(dst)
    return out


def _components(after: dict) -> dict:
    """The smallest node of its component, for each node on a cycle: one depth-first walk that keeps the nodes not yet given to a component."""
    index, low, open_, out = {}, {}, {}, {}
    for root in after:
        walk = [(root, iter(after.get(root, ())))] if root not in index else []
        if walk:
            index[root] = low[root] = len(index)
            open_[root] = None
        while walk:
            node, successors = walk[-1]
            for n in successors:
                if n not in index:
                    index[n] = low[n] = len(index)
                    open_[n] = None
                    walk.append((n, iter(after.get(n, ()))))
                    break
                if n in open_:
                    low[node] = min(low[node], index[n])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == index[node]:
                    members = [n for n in open_ if index[n] >= index[node]]
                    for n in members:
                        del open_[n]
                    if len(members) > 1 or node in after.get(node, ()):
                        out |= dict.fromkeys(members, min(members))
    return out


def _shortest_ring(after: dict, start, inside: set) -> list:
    """The shortest way from a node back to itself, of several the smallest list, level by level."""
    level, seen = {start: [start]}, set()
    while True:
        ahead: dict = {}
        for node in sorted(level, key=level.get):
            for n in after.get(node, ()):
                if n in inside and n not in seen:
                    ahead.setdefault(n, [*level[node], n])
        if start in ahead:
            return ahead[start]
        seen |= set(ahead)
        level = ahead


def cyclic(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of each node on a cycle, self-loops included.

    At most AT_HAND edges are walked by the driver. Of more, each round gives every node the smallest node that leads to it, and takes for each of those the nodes of its kind
    that lead back to it: a strongly connected component. No closure is built.
    """
    left = session.cut(edges.select("src", "dst").distinct())
    if (after := _at_hand(left)) is not None:
        kind = left.schema["src"].dataType.simpleString()
        return edges.sparkSession.createDataFrame(list(_components(after).items()), f"node {kind}, component {kind}")
    left, out = _trimmed(left), None
    while not left.isEmpty():
        color = session.cut(left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct().withColumn("color", F.col("node")))
        while True:
            heard = left.join(color.select(F.col("node").alias("src"), F.col("color").alias("heard")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("heard").alias("heard"))
            step = session.cut(color.join(heard, "node", "left").select("node", F.least("color", F.coalesce("heard", "color")).alias("color"), (F.col("heard") < F.col("color")).alias("moved")))
            color = step.select("node", "color")
            if step.where("moved").isEmpty():
                break
        same = left.join(color.select(F.col("node").alias("src"), "color"), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("other")), "dst").where("color = other")
        back = session.cut(same.select(F.col("dst").alias("node"), F.col("src").alias("before")))
        found = new = session.cut(color.where("node = color"))
        while True:
            step = new.join(back, "node").select(F.col("before").alias("node"), "color").distinct()
            new = session.cut(step.join(found, "node", "left_anti"))
            if new.isEmpty():
                break
            found = session.cut(found.unionByName(new))
        loops = left.where("src = dst").select(F.col("src").alias("node"))
        whole = found.groupBy("color").agg(F.count("*").alias("n"))
        members = session.cut(found.join(whole, "color").join(loops.withColumn("loop", F.lit(True)), "node", "left").where("n > 1 or loop").select("node", F.col("color").alias("component")))
        out = members if out is None else out.unionByName(members)
        gone = found.select("node")
        left = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        left = _trimmed(session.cut(left))
    return out if out is not None else edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)


def shortest_cycle(edges: DataFrame) -> DataFrame:
    """component and path, for each component of nodes on cycles: the shortest cycle through its smallest node, as the list of its nodes with that one first and last; of several the smallest list."""
    edges = session.cut(edges.select("src", "dst").distinct())
    if (after := _at_hand(edges)) is not None:
        kind = edges.schema["src"].dataType.simpleString()
        members: dict = {}
        for node, component in _components(after).items():
            members.setdefault(component, set()).add(node)
        rings = [(c, _shortest_ring(after, c, inside)) for c, inside in members.items()]
        return edges.sparkSession.createDataFrame(rings, f"component {kind}, path array<{kind}>")
    of = session.cut(cyclic(edges))
    inside = edges.select("src", "dst").distinct().join(of.select(F.col("node").alias("src"), "component"), "src").join(of.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst").where("component = other").select("component", "src", "dst")
    inside = session.cut(inside)
    paths = session.cut(inside.where("src = component").groupBy("component", "dst").agg(F.min(F.array("src", "dst")).alias("path")))
    levels = [paths]
    while not paths.isEmpty():
        # a component whose cycle is closed goes no further; each node is entered once, by its smallest path
        onward = paths.join(paths.where("dst = component").select("component"), "component", "left_anti").select("component", F.col("dst").alias("src"), "path")
        step = onward.join(inside, ["component", "src"]).groupBy("component", "dst").agg(F.min(F.array_append("path", F.col("dst"))).alias("path"))
        reached = reduce(DataFrame.unionByName, [p.select("component", "dst") for p in levels])
        paths = session.cut(step.join(reached, ["component", "dst"], "left_anti"))
        levels.append(paths)
    return reduce(DataFrame.unionByName, levels).where("dst = component").select("component", "path")


def redundant(edges: DataFrame, max_hops: int = 8, barriers: DataFrame | None = None) -> DataFrame:
    """Direct edges src -> dst that another direct dependency of src provides by a chain of at most max_hops re-exported links; the shortest, then the smallest dependency.

    Chains don't lead through src, nor through the nodes of barriers.
    """
    direct = session.dealt(session.cut(edges.select("src", "dst").distinct().where("src <> dst")))
    open_ = edges.where("visibility <> 'PRIVATE'").select(F.col("src").alias("at"), F.col("dst").alias("next")).distinct()
    if barriers is not None:
        open_ = open_.join(barriers.select(F.col("node").alias("at")), "at", "left_anti")
    open_ = session.dealt(session.cut(open_))
    new = direct.select("src", F.col("dst").alias("via"), F.col("dst").alias("at"))
    seen, found = [], []
    for hops in range(1, max_hops + 1):
        step = new.join(open_, "at").where("next <> src and next <> via").select("src", "via", F.col("next").alias("at")).distinct()
        for old in seen:
            step = step.join(old, ["src", "via", "at"], "left_anti")
        new = session.dealt(session.cut(step))
        if new.isEmpty():
            break
        seen.append(new)
        found.append(new.join(direct.withColumnRenamed("dst", "at"), ["src", "at"], "left_semi").select("src", F.col("at").alias("dst"), "via", F.lit(hops).alias("hops")))
    if not found:
        return direct.select("src", "dst", F.col("dst").alias("via"), F.lit(0).alias("hops")).limit(0)
    best = W.partitionBy("src", "dst").orderBy("hops", "via")
    return reduce(DataFrame.unionByName, found).withColumn("_r", F.row_number().over(best)).where("_r = 1").select("src", "dst", "via", "hops").transform(session.dealt)


def ancestors(nodes: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """(node, ancestor, hops), each node its own ancestor at 0 hops: the closure that replaces walks by row. ValueError if parents form a ring."""
    up = session.cut(nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent")))
    out = frontier = up.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("hops"))
    hops = 0
    while True:
        hops += 1
        step = frontier.select(F.col("node").alias("n"), "ancestor").join(up, F.col("ancestor") == F.col("node")).where("parent is not null")
        frontier = session.cut(step.select(F.col("n").alias("node"), F.col("parent").alias("ancestor"), F.lit(hops).alias("hops")))
        if frontier.isEmpty():
            return out
        if not frontier.where("node = ancestor").isEmpty():
            raise ValueError("a node is its own ancestor")
        out = out.unionByName(frontier)


def resolve_aliases(aliases: DataFrame) -> DataFrame:
    """name and resolved, following alias_of until a name that is no alias, or until the cycle guard stops."""
    link = session.cut(aliases.select(F.col("name").alias("at"), "alias_of"))
    rows = aliases.select("name", F.col("name").alias("at"), F.array("name").alias("seen"))
    while True:
        step = rows.join(link, "at", "left")
        go = F.col("alias_of").isNotNull() & ~F.array_contains("seen", F.col("alias_of"))
        step = session.cut(step.select("name", F.when(go, F.col("alias_of")).otherwise(F.col("at")).alias("at"), F.when(go, F.array_append("seen", F.col("alias_of"))).otherwise(F.col("seen")).alias("seen"), go.alias("moved")))
        rows = step.drop("moved")
        if step.where("moved").isEmpty():
            return rows.select("name", F.col("at").alias("resolved"))
