"""Rules on the build graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill import session
from tracemill.operators import graph
from tracemill.replay.effects import VISIBILITY
from tracemill.rules.base import Config, Store, finding, first, text

# Commands for a whole directory, and whether they reach targets made before them there.
DIRECTORY_COMMANDS = {"include_directories": True, "link_libraries": False, "add_definitions": True, "add_compile_definitions": True, "add_compile_options": False}
NODE = "\u0001"


def _key(name: str):
    return F.concat_ws(NODE, "recording", name)


def _graph(t: Store) -> DataFrame:
    """Edges between targets of the recording, whose nodes carry the recording's name."""
    return t.tgt_edges.where("dst_target is not null").select(_key("src_target").alias("src"), _key("dst_target").alias("dst"), "visibility")


def _name(c: str):
    return F.substring_index(c, NODE, -1)


def _directory(chain: str = "chain"):
    """The directory scope that a call acts on: the nearest one, through macros, includes and blocks; null inside a function or try_compile."""
    kind = lambda s: F.substring_index(s, ":", -1)
    through = F.filter(F.reverse(chain), lambda s: ~kind(s).isin("macro", "include", "unknown", "block"))
    top = F.get(through, F.lit(0))
    barred = F.exists(chain, lambda s: kind(s) == "try_compile")
    return F.when((kind(top) == "directory") & ~barred, F.substring_index(top, ":", 1).cast("long"))


def _affected(t: Store, calls: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """calls (recording, call_id, event_id, dir_scope, retroactive) with the targets they reach: made later below the directory, or, for retroactive ones, earlier in it. asked: recording, target and columns that calls have too; other targets of a call are left out."""
    made = t.targets.where("imported = 0 and alias_of is null and type <> 'UTILITY' and type <> 'INTERFACE'").select("recording", F.col("name").alias("target"), F.col("defined_event").alias("event_id"))
    made = made.join(t.flags().where("not in_try").select("recording", "event_id", "chain"), ["recording", "event_id"]).withColumn("own_scope", _directory())
    below = made.select("recording", "target", F.col("event_id").alias("made"), "own_scope", F.explode(F.transform("chain", lambda s: F.substring_index(s, ":", 1).cast("long"))).alias("dir_scope"))
    if asked is not None:
        below = below.join(asked, ["recording", "target"])
    reach = calls.join(below, ["recording", "dir_scope", *[c for c in below.columns if asked is not None and c in calls.columns and c not in ("recording", "dir_scope")]])
    return reach.where((F.col("made") > F.col("event_id")) | (F.col("retroactive") & F.coalesce(F.col("own_scope") == F.col("dir_scope"), F.lit(False))))


def _directory_calls(t: Store) -> DataFrame:
    late = [k for k, v in DIRECTORY_COMMANDS.items() if v]
    e = t.flags().where(F.col("cmd_lower").isin(list(DIRECTORY_COMMANDS))).where("in_source and not in_try").withColumn("dir_scope", _directory()).where("dir_scope is not null")
    return e.withColumns({"retroactive": F.col("cmd_lower").isin(late), "call_id": F.col("event_id")})


def directory_commands(t: Store, c: Config) -> DataFrame:
    key = ["recording", "file", "line", "node_id", "dir_scope", "cmd_lower", "retroactive"]
    g = _directory_calls(t).groupBy(*key).agg(F.min("event_id").alias("event_id"), F.count("*").alias("n")).withColumn("call_id", F.col("event_id"))
    hit = _affected(t, g.select("recording", "call_id", "event_id", "dir_scope", "retroactive")).groupBy("recording", "call_id").agg(F.count("*").alias("targets"), F.array_join(F.array_sort(F.collect_list("target")), ", ").alias("list"))
    g = g.join(hit, ["recording", "call_id"], "left")
    what = F.when(F.col("targets") > 0, text("reaches ", F.col("targets"), " targets: ", F.col("list"))).otherwise("is a dead directory command: it reaches no target")
    return finding(g, "directory-commands", "note", text(F.col("cmd_lower"), "() ", what, F.when(F.col("n") > 1, text(" (", F.col("n"), " evaluations)")).otherwise("")))


def overshare(t: Store, c: Config) -> DataFrame:
    """Without dependency files one note for each recording says so."""
    if t.tu_headers is None:
        one = t.events.select("recording").distinct().withColumns({"file": F.lit("<recording>"), "line": F.lit(0)})
        return finding(one, "overshare", "note", text("no compiler dependency files were recorded, so shared folders can't be checked"))
    own = t.usage_reqs.where("kind = 'include' and source = 'trace' and visibility in ('PUBLIC', 'INTERFACE')").withColumn("value", F.regexp_replace("value", "/+$", ""))
    used = t.tu_headers.select("recording", F.col("target").alias("user"), "header_path").distinct()
    users = graph.consumers(_graph(t)).select(F.substring_index("target", NODE, 1).alias("recording"), _name("target").alias("target"), _name("consumer").alias("user"))
    asked = own.select("recording", "target", "value").distinct()
    # folders of a header, one row each, so that the match is by equality
    deep = F.sequence(F.lit(1), F.greatest(F.size(F.split("header_path", "/")) - 1, F.lit(1)))
    folders = used.select("recording", "user", F.explode(F.transform(deep, lambda i: F.array_join(F.slice(F.split("header_path", "/"), F.lit(1), i), "/"))).alias("value")).distinct()
    hits = asked.join(folders, ["recording", "value"])
    by_consumer = hits.join(users, ["recording", "target", "user"], "left_semi").select("recording", "target", "value").distinct()
    by_self = hits.where("user = target").select("recording", "target", "value").distinct().withColumn("self", F.lit(True))
    some = users.select("recording", "target").distinct().withColumn("consumed", F.lit(True))
    d = own.join(by_consumer, ["recording", "target", "value"], "left_anti").join(by_self, ["recording", "target", "value"], "left").join(some, ["recording", "target"], "left")
    d = d.where((F.col("visibility") == "PUBLIC") | F.col("consumed") | F.col("self")).where(~c.ignored("overshare", F.col("target")))
    d = t.at(d.withColumnRenamed("origin_event", "event_id"))
    return finding(d, "overshare", "note", text("'", F.col("target"), "' shares the folder '", F.col("value"), "' with consumers that use nothing in it"))


def occurrences(t: Store) -> DataFrame:
    """Each mention of a library in a link call or property: recording, event_id, src_target, dst, visibility, slot (all, debug or optimized)."""
    link = t.flags().where("cmd_lower = 'target_link_libraries'")
    items = F.flatten(F.transform(F.slice("args", 2, F.greatest(F.size("args") - 1, F.lit(0))), lambda a: F.split(a, ";")))
    vis = F.create_map(*[F.lit(x) for kv in VISIBILITY.items() for x in kv])
    start = F.struct(F.lit("PUBLIC").alias("v"), F.lit("all").alias("s"), F.array().cast("array<struct<dst:string,visibility:string,slot:string>>").alias("out"))

    def step(acc, a):
        is_vis, is_slot = F.map_contains_key(vis, a), a.isin("debug", "optimized", "general")
        one = F.struct(a.alias("dst"), acc["v"].alias("visibility"), acc["s"].alias("slot"))
        return F.struct(
            F.when(is_vis, vis[a]).otherwise(acc["v"]).alias("v"), F.when(is_slot, F.when(a == "general", "all").otherwise(a)).when(is_vis | (a == ""), acc["s"]).otherwise("all").alias("s"),
            F.when(is_vis | is_slot | (a == ""), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    walked = link.select("recording", "event_id", F.explode(F.aggregate(items, start, step)["out"]).alias("o")).select("recording", "event_id", "o.*")
    edges = t.tgt_edges.select("recording", F.col("origin_event").alias("event_id"), "src_target", "dst", "visibility")
    owner = edges.select("recording", "event_id", "src_target").distinct()
    by_property = edges.join(link.select("recording", "event_id"), ["recording", "event_id"], "left_anti").withColumn("slot", F.lit("all"))
    return walked.join(owner, ["recording", "event_id"]).unionByName(by_property)


def duplicates(t: Store, c: Config) -> DataFrame:
    o = t.at(occurrences(t)).where(~F.col("dst").contains("$<") & ~c.ignored("duplicate-links", F.col("src_target")) & ~c.ignored("duplicate-links", F.col("dst")))
    g = o.groupBy("recording", "src_target", "dst", "slot").agg(
        F.count("*").alias("n"), F.countDistinct("visibility").alias("kinds"), F.max("in_source").alias("own"), F.array_sort(F.collect_list(F.struct("event_id", "file", "line", "visibility"))).alias("at")).where("n > 1 and own")
    last = F.element_at("at", -1)
    g = g.withColumns({"file": last["file"], "line": last["line"]})
    related = F.transform(F.slice("at", 1, F.size("at") - 1), lambda a: F.struct(a["file"].alias("file"), a["line"].alias("line"), F.concat(F.lit("linked here as "), a["visibility"]).alias("note")))
    return finding(g, "duplicate-links", F.when(F.col("kinds") > 1, "warning").otherwise("note"), text("'", F.col("src_target"), "' links '", F.col("dst"), "' ", F.col("n"), " times", F.when(F.col("kinds") > 1, " with different visibility").otherwise("")), related=related)


def cycles(t: Store, c: Config) -> DataFrame:
    imported = t.targets.where("imported = 1").select(_key("name").alias("node"))
    on = graph.cyclic(_graph(t).select("src", "dst"))
    out = on.join(imported, "node", "left_semi").unionByName(on.where(c.ignored("cyclic-links", _name("node")))).select("component").distinct()
    on = on.join(out, "component", "left_anti")
    hop = t.at(t.tgt_edges.where("dst_target is not null").withColumnRenamed("origin_event", "event_id")).withColumns({"src": _key("src_target"), "dst": _key("dst_target")})
    hop = hop.join(on.select(F.col("node").alias("src"), "component"), "src").join(on.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst").where("component = other")
    g = hop.groupBy("recording", "component").agg(F.max("in_source").alias("own"), F.array_sort(F.collect_list(F.struct("event_id", "file", "line", "src_target", "dst_target"))).alias("hops"), F.array_join(F.array_sort(F.collect_set("src_target")), ", ").alias("members")).where("own")
    g = g.withColumns({"file": F.col("hops")[0]["file"], "line": F.col("hops")[0]["line"]})
    related = F.transform(F.slice("hops", 2, F.greatest(F.size("hops") - 1, F.lit(0))), lambda h: F.struct(h["file"].alias("file"), h["line"].alias("line"), F.concat(h["src_target"], F.lit(" links "), h["dst_target"]).alias("note")))
    ring = graph.shortest_cycle(_graph(t).select("src", "dst")).select("component", F.array_join(F.transform("path", lambda n: F.substring_index(n, NODE, -1)), " -> ").alias("ring"))
    g = g.join(ring, "component", "left")
    return finding(g, "cyclic-links", "note", text("targets link each other in a ring, ", F.col("ring"), ", among: ", F.col("members")), related=related)


def redundant(t: Store, c: Config) -> DataFrame:
    skip = ["INTERFACE", "OBJECT"]
    a = t.targets.where((F.col("imported") == 0) & F.col("alias_of").isNull() & ~F.coalesce("type", F.lit("")).isin(skip)).select("recording", F.col("name").alias("src_target"))
    b = t.targets.where((F.col("imported") == 0) & (F.coalesce("type", F.lit("")) != "OBJECT")).select("recording", F.col("name").alias("dst_target"))
    direct = t.at(t.tgt_edges.where("dst_target is not null").withColumnRenamed("origin_event", "event_id")).where("in_source and not in_try").where(~F.col("dst").contains("$<"))
    shared = t.tgt_edges.groupBy("recording", F.col("origin_event").alias("event_id")).agg(F.countDistinct("src_target").alias("sources")).where("sources = 1")
    direct = direct.join(a, ["recording", "src_target"], "left_semi").join(b, ["recording", "dst_target"], "left_semi").join(shared, ["recording", "event_id"], "left_semi")
    direct = direct.where(~c.ignored("redundant-links", F.col("src_target")) & ~c.ignored("redundant-links", F.col("dst_target")))
    objects = t.targets.where("type = 'OBJECT'").select(_key("name").alias("node"))
    via = graph.redundant(_graph(t), barriers=objects).select("src", "dst", _name("via").alias("via"))
    d = first(direct, ["src_target", "dst_target"]).withColumns({"src": _key("src_target"), "dst": _key("dst_target")}).join(via, ["src", "dst"])
    return finding(d, "redundant-links", "note", text("'", F.col("src_target"), "' links '", F.col("dst_target"), "', which '", F.col("via"), "' provides already"))


def shadowed(t: Store, c: Config) -> DataFrame:
    """Includes and definitions that reach a target by two or more of: its own call, a directory command, a direct dependency; alike in SYSTEM, calls in the same folder."""
    kinds = F.when(F.col("kind") == "include", F.regexp_replace("value", "/+$", "")).otherwise(F.col("value"))
    folder = F.regexp_extract("file", "^(.*)/", 1)
    own = t.at(t.usage_reqs.where("source = 'trace' and kind in ('include', 'define')").withColumnRenamed("origin_event", "event_id")).where("in_source and not in_try").where(~F.col("value").contains("$<"))
    own = own.withColumns({"value": kinds, "system": F.array_contains("args", "SYSTEM"), "folder": folder})
    cols = ["recording", "target", "kind", "value", "system", "folder", "event_id", "file", "line"]
    direct = own.where("visibility <> 'INTERFACE'").select(*cols, F.lit("direct").alias("route"))
    passed = own.where("visibility <> 'PRIVATE'").withColumnRenamed("target", "dep")
    edges = t.tgt_edges.where("dst_target is not null and visibility <> 'INTERFACE'").select("recording", F.col("src_target").alias("target"), F.col("dst_target").alias("dep")).distinct()
    hop = passed.join(edges, ["recording", "dep"]).select(*cols, F.lit("dependency").alias("route"))
    calls = _directory_calls(t).where(F.col("cmd_lower").isin("include_directories", "add_definitions", "add_compile_definitions"))
    kind = F.when(F.col("cmd_lower") == "include_directories", "include").otherwise("define")
    words = calls.select("recording", "call_id", "dir_scope", "retroactive", kind.alias("kind"), F.array_contains("args", "SYSTEM").alias("system"), folder.alias("folder"), "event_id", "file", "line", F.explode(F.flatten(F.transform("args", lambda a: F.split(a, ";")))).alias("value"))
    words = words.where(~F.col("value").isin("", "SYSTEM", "BEFORE", "AFTER") & ~F.col("value").contains("$<")).withColumn("value", F.when(F.col("kind") == "include", F.regexp_replace("value", "/+$", "")).otherwise(F.regexp_replace("value", "^-D", "")))
    # what a directory command alone brings is no finding, so it is held only against what targets have by other routes, not against all targets
    routes = session.dealt(session.cut(direct.unionByName(hop)))
    words = _affected(t, words, routes.select("recording", "target", "kind", "value", "system", "folder").distinct())
    routes = routes.unionByName(words.select(*cols, F.lit("directory").alias("route"))).where(~c.ignored("shadowed-requirements", F.col("target")) & ~c.ignored("shadowed-requirements", F.col("value")))
    g = routes.groupBy("recording", "target", "kind", "value", "system", "folder").agg(F.array_sort(F.collect_set("route")).alias("routes"), F.min_by(F.struct("file", "line"), F.struct(F.when(F.col("route") == "direct", 0).otherwise(1), F.col("event_id"))).alias("p")).where("size(routes) > 1")
    g = g.select("*", F.col("p.file").alias("file"), F.col("p.line").alias("line"))
    return finding(g, "shadowed-requirements", "note", text(F.col("kind"), " '", F.col("value"), "' reaches '", F.col("target"), "' by several routes: ", F.array_join("routes", ", ")))
