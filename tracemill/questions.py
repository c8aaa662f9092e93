"""Questions to recordings: why a value, a link or a requirement is there, what differs, where the time goes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill.functions import text as X
from tracemill.operators import compare, graph
from tracemill.rules.base import Store, after, text
from tracemill.rules.calls import pinning_problem

MOST_ROWS = 10_000


def call_chains(t: Store) -> DataFrame:
    """recording, scope_id, chain_text: the scopes around a scope, outermost first, with the places of their calls."""
    hop = t.scopes.select("recording", "scope_id", F.posexplode("chain").alias("i", "s")).withColumn("at", F.substring_index("s", ":", 1).cast("long"))
    by = t.scopes.select("recording", F.col("scope_id").alias("at"), "kind", "name", F.col("opened_by_event").alias("event_id"))
    place = t.events.select("recording", "event_id", "file", "line")
    named = hop.join(by, ["recording", "at"]).join(place, ["recording", "event_id"], "left")
    label = text(F.col("kind"), " ", F.col("name"), F.when(F.col("file").isNotNull(), text(" (", F.col("file"), ":", F.col("line"), ")")))
    return named.groupBy("recording", "scope_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", label.alias("l")))), lambda x: x["l"]), " > ").alias("chain_text"))


def why_value(t: Store, name: str, file: str | None = None, line: int | None = None) -> DataFrame:
    """Writes of a name in order, with the reads that resolved to each and the calls around it; with a place, those its reads resolved to. file matches as a suffix of the path."""
    w = t.var_writes.where(F.col("name") == name)
    if file is not None:
        here = t.events.where(F.col("file").endswith(file) & (F.col("line") == line)).select("recording", "event_id")
        got = t.var_reads.where(F.col("name") == name).join(here, ["recording", "event_id"], "left_semi")
        w = w.join(got.select("recording", F.col("resolved_write_id").alias("write_id")), ["recording", "write_id"], "left_semi")
    reads = t.var_reads.groupBy("recording", F.col("resolved_write_id").alias("write_id")).agg(F.count("*").alias("reads"))
    kinds = t.scopes.select("recording", "scope_id", F.col("kind").alias("scope_kind"))
    place = t.events.select("recording", "event_id", "file", "line")
    d = w.join(place, ["recording", "event_id"], "left").join(kinds, ["recording", "scope_id"], "left").join(reads, ["recording", "write_id"], "left").join(call_chains(t), ["recording", "scope_id"], "left")
    return d.select("recording", "write_id", "file", "line", "value", "write_kind", F.coalesce("scope_kind", F.lit("cache")).alias("scope_kind"), F.coalesce("reads", F.lit(0)).alias("reads"), "chain_text").orderBy("recording", "write_id")


def _edges(t: Store) -> DataFrame:
    return t.tgt_edges.select(F.concat_ws("\u0001", "recording", "src_target").alias("src"), F.concat_ws("\u0001", "recording", F.coalesce("dst_target", "dst")).alias("dst"), "visibility")


def why_links(t: Store, target: str, library: str, most_edges: int = 32, most_paths: int = 64) -> DataFrame:
    """Simple paths by which a library reaches a target, each hop with its visibility and place: recording, path_id (from 1, shortest path first), hop, src, dst, visibility, file, line.

    The library may be a target, a file, or a name behind -l or ::. Paths have at most most_edges edges; the shortest
    most_paths of a recording are given.
    """
    e = _edges(t).distinct()
    tail = lambda c: F.substring_index(c, "\u0001", -1)
    starts = e.where(tail("src") == target).select("src").distinct()
    goal = lambda c: X.same_library(tail(c), F.lit(None).cast("string"), library)
    paths = graph.simple_paths(e.select("src", "dst", "visibility"), starts, goal, most_edges).select("path").distinct()
    paths = paths.withColumn("recording", F.substring_index(F.col("path")[0], "\u0001", 1))
    paths = paths.withColumn("path_id", F.row_number().over(W.partitionBy("recording").orderBy(F.size("path"), "path"))).where(F.col("path_id") <= most_paths)
    pairs = F.transform(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.struct(F.get("path", i).alias("src"), F.get("path", i + 1).alias("dst")))
    hops = paths.select("recording", "path_id", F.posexplode(pairs).alias("hop", "p")).select("recording", "path_id", "hop", tail("p.src").alias("src"), tail("p.dst").alias("dst"))
    place = t.tgt_edges.select("recording", F.col("src_target").alias("src"), F.coalesce("dst_target", "dst").alias("dst"), "visibility", F.col("origin_event").alias("event_id")).join(t.events.select("recording", "event_id", "file", "line"), ["recording", "event_id"], "left")
    return hops.join(place, ["recording", "src", "dst"]).select("recording", "path_id", "hop", "src", "dst", "visibility", "file", "line").orderBy("recording", "path_id", "hop")


def path_tree(hops: DataFrame) -> dict:
    """The paths of why_links as a tree of prefixes, by recording: children of a node are told apart by name and visibility, in the order of the paths. At most 64 short paths a recording come to the driver."""
    paths: dict[tuple, dict[int, tuple[str, str, str]]] = {}
    for r in hops.orderBy("recording", "path_id", "hop", "visibility").collect():
        paths.setdefault((r.recording, r.path_id), {}).setdefault(r.hop, (r.src, r.dst, r.visibility))
    tree: dict = {}
    for (recording, _), path in paths.items():
        node = tree.setdefault(recording, {}).setdefault((path[0][0], None), {})
        for _, dst, visibility in path.values():
            node = node.setdefault((dst, visibility), {})
    return tree


def isomorphic(t: Store, left: str, right: str) -> DataFrame:
    """problem: targets of one recording only, and resolved requirements that a target of both lost or gained. None if a rewrite left the build graph as it was."""
    of = lambda df, r: df.where(F.col("recording") == r).drop("recording").distinct()
    names = t.targets.where("in_file_api = 1").select("recording", "name")
    a, b = of(names, left), of(names, right)
    label = lambda text, *c: F.format_string(text, *c).alias("problem")
    both = a.join(b, ["name"], "left_semi")
    reqs = t.usage_reqs.where("source = 'fileapi'").select("recording", F.col("target").alias("name"), "kind", "value")
    ra, rb = (of(reqs, r).join(both, ["name"], "left_semi") for r in (left, right))
    parts = [
        a.join(b, ["name"], "left_anti").select(label("target disappeared: %s", "name")), b.join(a, ["name"], "left_anti").select(label("target appeared: %s", "name")),
        ra.join(rb, ["name", "kind", "value"], "left_anti").select(label("%s: lost %s '%s'", "name", "kind", "value")), rb.join(ra, ["name", "kind", "value"], "left_anti").select(label("%s: gained %s '%s'", "name", "kind", "value")),
    ]
    return reduce(DataFrame.unionByName, parts)


def why_requirement(t: Store, target: str, kind: str, value: str) -> DataFrame:
    """Where an include, define or option of a target comes from: its own call, or that of a dependency which hands it on."""
    reach = graph.closure(_edges(t).where("visibility <> 'PRIVATE'").select("src", "dst"))
    first = _edges(t).where(F.substring_index("src", "\u0001", -1) == target).select("src", "dst")
    onward = first.join(reach.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
    near = first.unionByName(onward).distinct().select(F.substring_index("src", "\u0001", 1).alias("recording"), F.substring_index("dst", "\u0001", -1).alias("target"))
    r = t.usage_reqs.where((F.col("kind") == kind) & F.col("value").contains(value) & (F.col("source") == "trace"))
    own = r.where((F.col("target") == target) & (F.col("visibility") != "INTERFACE"))
    handed = r.where("visibility <> 'PRIVATE'").join(near, ["recording", "target"], "left_semi").where(F.col("target") != target)
    place = t.events.select("recording", F.col("event_id").alias("origin_event"), "file", "line")
    return own.unionByName(handed).join(place, ["recording", "origin_event"], "left").select("recording", "target", "kind", "value", "visibility", "file", "line")


def diff(t: Store, left: str, right: str) -> DataFrame:
    """Targets, links, requirements, properties and cache entries of one recording only: section, item, side."""
    of = lambda df, r: df.where(F.col("recording") == r)
    item = lambda *c: F.concat_ws(" ", *c).alias("item")
    last = t.var_writes.where("write_kind = 'cache'").groupBy("recording", "name").agg(F.max_by(F.coalesce("value", F.lit("?")), "write_id").alias("value"))
    parts = {
        "targets": t.targets.select("recording", item("name", F.coalesce("type", F.lit("")))), "links": t.tgt_edges.select("recording", item("src_target", "visibility", "dst")),
        "requirements": t.usage_reqs.select("recording", item("target", F.coalesce("visibility", F.lit("")), "kind", "value")), "properties": t.tgt_props.select("recording", item("target", "prop", "value")),
        "cache": last.select("recording", item("name", "value")),
    }
    out = None
    for section, df in parts.items():
        d = compare.difference(of(df, left), of(df, right), ["item"]).select(F.lit(section).alias("section"), "item", "side")
        out = d if out is None else out.unionByName(d)
    return out


def explain(t: Store, file: str, line: int, most: int = 5) -> DataFrame:
    """The evaluations of the command that stands on a line, by argument set: how often, first and last, and what they wrote and linked."""
    own = t.commands.where(F.col("file").endswith(file)).withColumn("lines", F.size(F.split("args_text", "\n")))
    here = own.where((F.col("line") <= line) & (F.col("line") + F.col("lines") > line)).select("recording", "file", "node_id")
    e = t.events.join(here, ["recording", "file", "node_id"], "left_semi")
    w = t.var_writes.groupBy("recording", "event_id").agg(F.count("*").alias("writes"))
    l = t.tgt_edges.groupBy("recording", F.col("origin_event").alias("event_id")).agg(F.count("*").alias("links"))
    g = e.join(w, ["recording", "event_id"], "left").join(l, ["recording", "event_id"], "left").groupBy("recording", "file", "line", "cmd", "args_json").agg(
        F.count("*").alias("evaluations"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.coalesce(F.sum("writes"), F.lit(0)).alias("writes"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"))
    return g.orderBy(F.desc("evaluations"), "first_event").limit(most)


def why_not_run(t: Store, command: str) -> DataFrame:
    """Places of a command, each with its status: ran, guard-failed, uncalled, file-never-ran or not-reached."""
    c = t.commands.where(F.col("name_lower") == command.lower())
    ran = t.events.groupBy("recording", "file", "node_id").agg(F.count("*").alias("n"))
    files = t.events.select("recording", "file").distinct().withColumn("file_ran", F.lit(True))
    kind = F.element_at("blocks", -1)["kind"]
    status = (
        F.when(F.col("n") > 0, "ran").when(F.col("file_ran").isNull(), "file-never-ran").when(F.exists("blocks", lambda b: b["kind"].isin("function_def", "macro_def")), "uncalled")
        .when(F.exists("blocks", lambda b: b["kind"].isin("if_condition", "while_loop", "foreach_loop")), "guard-failed").otherwise("not-reached"))
    d = c.join(ran, ["recording", "file", "node_id"], "left").join(files, ["recording", "file"], "left")
    return d.select("recording", "file", "line", status.alias("status"), F.when(F.size("blocks") > 0, F.concat_ws(" ", kind, F.element_at("blocks", -1)["head"])).alias("inside"), F.coalesce("n", F.lit(0)).alias("evaluations"))


def hotspots(t: Store, by: str = "cmd_lower") -> DataFrame:
    """Time by command, file, or function (by = scope): calls, total_us, mean_us."""
    e = t.flags().withColumn("scope", F.coalesce("scope_name", F.lit("")))
    g = e.groupBy("recording", by).agg(F.count("*").alias("calls"), F.sum("elapsed_us").alias("total_us"))
    return g.withColumn("mean_us", F.expr("total_us div calls"))


def stacks(t: Store) -> DataFrame:
    """recording, stack, self_us of each event: the scopes around it and its command, joined by semicolons."""
    named = t.scopes.select("recording", "scope_id", F.posexplode("chain").alias("i", "s")).withColumn("at", F.substring_index("s", ":", 1).cast("long"))
    label = t.scopes.select("recording", F.col("scope_id").alias("at"), F.regexp_replace(F.coalesce(F.when(F.col("name") != "", F.col("name")), F.lit("root")), "[; ]", "_").alias("l"))
    path = named.join(label, ["recording", "at"]).groupBy("recording", "scope_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "l"))), lambda x: x["l"]), ";").alias("path"))
    return t.events.join(path, ["recording", "scope_id"]).select("recording", F.concat_ws(";", "path", "cmd_lower").alias("stack"), F.col("elapsed_us").alias("self_us"))


def dependencies(t: Store) -> DataFrame:
    """find_package and FetchContent calls: name, version asked for, found (by the variable <name>_FOUND), required, source, pinning and package URL."""
    e = t.flags().where("in_source and not in_try and size(args) > 0").withColumn("name", F.col("args")[0])
    found = t.var_writes.where("name like '%\\\\_FOUND'").groupBy("recording", F.lower(F.expr("substring(name, 1, length(name) - 6)")).alias("key")).agg(F.max_by("value", "write_id").alias("value"))
    p = e.where("cmd_lower = 'find_package'").withColumn("key", F.lower("name")).join(found, ["recording", "key"], "left")
    version = F.get("args", F.lit(1))
    empty = F.lit(None).cast("string")
    packages = p.select("recording", "name", F.lit("find_package").alias("how"), F.when(version.rlike("^[0-9][0-9.<]*$"), version).alias("version"), F.array_contains("args", "REQUIRED").alias("required"), X.is_true(F.col("value")).alias("found"), empty.alias("source"), empty.alias("problem"), empty.alias("purl"), "file", "line")
    f = e.where(F.col("cmd_lower").isin("fetchcontent_declare", "externalproject_add")).withColumn("args", F.filter("args", lambda a: a != ""))
    repo, tag = after("args", "GIT_REPOSITORY"), after("args", "GIT_TAG")
    path = F.regexp_extract(repo, r"github\.com[/:]([^/]+/[^/]+?)(?:\.git)?/?$", 1)
    purl = F.when((path != "") & X.full_commit(tag), F.concat(F.lit("pkg:github/"), F.lower(path), F.lit("@"), tag))
    fetched = f.select("recording", "name", F.col("cmd_lower").alias("how"), tag.alias("version"), F.lit(True).alias("required"), F.lit(None).cast("boolean").alias("found"), F.coalesce(repo, after("args", "URL")).alias("source"), pinning_problem(F.col("args")).alias("problem"), purl.alias("purl"), "file", "line")
    return packages.unionByName(fetched)


def sql(spark: SparkSession, tables: dict[str, DataFrame], statement: str) -> DataFrame:
    """A query over the tables as views. Queries only; json_extract(x, '$[n]') is taken as get_json_object."""
    if not re.match(r"\s*(--[^\n]*\n\s*)*(select|with|values|from)\b", statement, re.I):
        raise ValueError("only queries are allowed")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(re.sub(r"\bjson_extract\s*\(", "get_json_object(", statement))


def sql_rule(spark: SparkSession, tables: dict[str, DataFrame], rule: str, statement: str, most: int | None = MOST_ROWS) -> DataFrame:
    """Findings of a user's query with columns file, line, message, and perhaps severity and recording. More than `most` rows are an error, as such a query over one build is wrong; None, for tables of many builds, gives all rows and doesn't count them."""
    rows = sql(spark, tables, statement)
    lacking = {"file", "line", "message"} - set(rows.columns)
    if lacking:
        raise ValueError(f"{rule}: the query has no column {', '.join(sorted(lacking))}")
    if most is not None and len(rows.limit(most + 1).select("file").take(most + 1)) > most:
        raise ValueError(f"{rule}: more than {most} findings")
    col = lambda n, other: F.col(n) if n in rows.columns else F.lit(other)
    return rows.select(col("recording", "").alias("recording"), F.lit(rule).alias("rule"), col("severity", "warning").alias("severity"), "file", F.col("line").cast("bigint").alias("line"), "message", F.array().cast("array<struct<file:string,line:bigint,note:string>>").alias("related"))
