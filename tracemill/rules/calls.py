"""Rules on single calls: their arguments, and what all evaluations of one place have in common."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text as X
from tracemill.rules.base import Config, Store, after, finding, first, text

# Policies that are often pinned, with the version that brought them.
POLICIES = {
    "CMP0022": "2.8.12", "CMP0042": "3.0", "CMP0048": "3.0", "CMP0054": "3.1", "CMP0060": "3.3", "CMP0063": "3.3", "CMP0067": "3.8", "CMP0074": "3.12",
    "CMP0077": "3.13", "CMP0079": "3.13", "CMP0091": "3.15", "CMP0104": "3.18", "CMP0116": "3.20", "CMP0126": "3.21", "CMP0135": "3.24",
}
# Arguments before what a call adds, and words that add nothing.
TARGET_WORDS = ["PRIVATE", "PUBLIC", "INTERFACE", "BEFORE", "SYSTEM"]
PAYLOADS: dict[str, tuple[int, list[str]]] = {
    "target_link_libraries": (1, TARGET_WORDS), "target_include_directories": (1, TARGET_WORDS), "target_compile_definitions": (1, TARGET_WORDS),
    "target_compile_options": (1, TARGET_WORDS), "target_sources": (1, TARGET_WORDS), "target_link_options": (1, TARGET_WORDS),
    "include_directories": (0, ["AFTER", "BEFORE", "SYSTEM"]), "add_definitions": (0, []), "add_compile_definitions": (0, []), "add_compile_options": (0, []),
    "link_libraries": (0, []), "list": (2, []),
}
#: A generator expression without another inside: where one is complete, an innermost one is.
GENEX = r"(?<!\\)(\$<[^<>$]*>)"
GENEX_SOURCES = 4
RESULT_WORDS = ["RESULT_VARIABLE", "RESULTS_VARIABLE"]


def genex(t: Store, c: Config) -> DataFrame:
    cmd, sub = F.col("cmd_lower"), F.get("args", F.lit(0))
    hard = cmd.isin("if", "elseif", "while", "execute_process")
    soft = cmd.isin("message", "configure_file", "math") | ((cmd == "file") & sub.isin("WRITE", "APPEND", "READ")) | ((cmd == "string") & (sub == "COMPARE"))
    e = t.flags().where("in_source and not in_try").where((hard | soft) & F.exists("args", lambda a: a.rlike(GENEX)))
    w = t.at(t.var_writes.where(F.col("value").rlike(GENEX)), prefix="w_").select("recording", F.col("write_id").alias("resolved_write_id"), F.struct(F.col("w_file").alias("file"), F.col("w_line").alias("line"), F.lit("stored here").alias("note")).alias("place"))
    fed = t.var_reads.join(w, ["recording", "resolved_write_id"]).groupBy("recording", "event_id").agg(F.slice(F.array_sort(F.collect_set("place")), 1, GENEX_SOURCES).alias("related"), F.max(c.ignored("genex-in-wrong-context", F.col("name"))).alias("foreign"))
    e = e.join(fed, ["recording", "event_id"], "left").where(~F.coalesce("foreign", F.lit(False)))
    found = F.regexp_extract(F.filter("args", lambda a: a.rlike(GENEX))[0], GENEX, 1)
    return finding(e, "genex-in-wrong-context", F.when(hard, "warning").otherwise("note"), text("`", found, "` reaches ", cmd, "(), which takes it as plain text"), related=F.coalesce("related", F.array()))


def unchecked_processes(t: Store, c: Config) -> DataFrame:
    e = t.flags().where("cmd_lower = 'execute_process' and in_source and not in_try")
    names = F.filter(F.array(*[after("args", w) for w in RESULT_WORDS]), lambda n: n.isNotNull())
    e = e.withColumn("results", names)
    writes = e.select("recording", "event_id", F.explode("results").alias("name")).join(t.var_writes.select("recording", "event_id", "name", "write_id"), ["recording", "event_id", "name"])
    reads = t.var_reads.select("recording", F.col("resolved_write_id").alias("write_id"), F.col("event_id").alias("read_event"))
    looked = writes.join(reads, ["recording", "write_id"]).where("read_event > event_id").select("recording", "event_id").distinct().withColumn("looked", F.lit(True))
    e = e.join(looked, ["recording", "event_id"], "left")
    off = F.exists("results", lambda n: c.ignored("execute-process-unchecked", n))
    g = e.groupBy("recording", "file", "line").agg(
        F.max(F.array_contains("args", "COMMAND_ERROR_IS_FATAL") | F.coalesce("looked", F.lit(False))).alias("checked"), F.max(F.array_contains("args", "ERROR_QUIET")).alias("quiet"),
        F.max(F.size("results") > 0).alias("named"), F.max(off).alias("off"), F.min_by(after("args", "COMMAND"), "event_id").alias("program")).where("not checked and not off")
    why = F.when(F.col("named"), "its result variable is never read").otherwise("nothing checks whether it failed")
    return finding(g, "execute-process-unchecked", "note", text("execute_process of '", F.col("program"), "': ", why, F.when(F.col("quiet"), "; its errors are not shown either").otherwise("")))


def policies(t: Store, c: Config) -> DataFrame:
    a = F.col("args")
    e = t.flags().where("cmd_lower = 'cmake_policy' and in_source and not in_try").where((F.size(a) == 3) & (F.get(a, F.lit(0)) == "SET") & (F.get(a, F.lit(2)) == "OLD"))
    e = e.withColumn("name", F.get(a, F.lit(1))).where(~c.ignored("policy-hygiene", F.col("name")))
    known = reduce(lambda out, p: out.when(F.col("name") == p, POLICIES[p]), POLICIES, F.when(F.lit(False), ""))
    since = F.when(known.isNotNull(), text(" (new behaviour since ", known, ")")).otherwise("")
    return finding(first(e, ["file", "line", "name"]), "policy-hygiene", "warning", text("policy ", F.col("name"), " is pinned to OLD", since))


def diagnostics(t: Store, c: Config) -> DataFrame:
    if t.configure_diagnostics is None:
        return finding(t.events.where(F.lit(False)), "configure-warnings", "note", text(""))
    d = t.configure_diagnostics.withColumn("file", F.when(F.coalesce("file", F.lit("")) == "", "<configure>").otherwise(F.col("file")))
    return finding(d, "configure-warnings", F.col("severity"), text(F.when(F.col("kind") != "", text("(", F.col("kind"), ") ")).otherwise(""), F.col("message")))


def cache_force(t: Store, c: Config) -> DataFrame:
    a = F.col("args")
    e = t.flags().where("cmd_lower = 'set' and in_source and not in_try").where(F.array_contains(a, "CACHE") & (F.element_at(a, -1) == "FORCE"))
    at = F.array_position(a, "CACHE").cast("int")
    e = e.withColumns({"name": a[0], "type": F.get(a, at), "doc": F.get(a, at + 1)}).where("type <> 'INTERNAL' and name <> ''").where(~c.ignored("set-cache-force", F.col("name")))
    e = e.withColumn("place", F.coalesce("node_id", -F.col("event_id")))
    guard = F.exists("blocks", lambda b: (b["kind"] == "if_condition") & F.array_contains(F.split(b["head"], r"[^A-Za-z0-9_]+"), F.col("name")))
    g = e.groupBy("recording", "file", "line", "place").agg(F.min(F.coalesce(guard, F.lit(False))).alias("guarded"), F.min_by("name", "event_id").alias("name"), F.min_by("doc", "event_id").alias("doc"), F.countDistinct("name").alias("n"))
    mild = F.col("guarded") | (F.coalesce("doc", F.lit("")) == "")
    return finding(g, "set-cache-force", F.when(mild, "note").otherwise("warning"), text("the cache entry '", F.col("name"), "' is overwritten on every run", F.when(F.col("n") > 1, text(", and ", F.col("n") - 1, " more here")).otherwise("")))


def pinning_problem(args: Column) -> Column:
    """Why a fetched dependency isn't fixed to one content, or null."""
    tag = after(args, "GIT_TAG")
    git = F.when(tag.isNull(), "follows the default branch of its repository").when(~X.full_commit(tag), text("is fetched at '", tag, "', which can move"))
    url = F.when(after(args, "URL_HASH").isNull() & after(args, "URL_MD5").isNull(), "is downloaded without a hash")
    return F.when(after(args, "GIT_REPOSITORY").isNotNull(), git).when(after(args, "URL").isNotNull(), url)


def pinning(t: Store, c: Config) -> DataFrame:
    e = t.flags().where(F.col("cmd_lower").isin("fetchcontent_declare", "externalproject_add")).where("in_source")
    e = first(e.withColumn("place", F.coalesce("node_id", -F.col("event_id"))), ["file", "place"]).where("not in_try")
    e = e.withColumn("args", F.filter("args", lambda a: a != "")).where("size(args) > 0").withColumn("name", F.col("args")[0]).where(~c.ignored("fetchcontent-pinning", F.col("name")))
    e = e.withColumn("why", pinning_problem(F.col("args"))).where("why is not null")
    return finding(e, "fetchcontent-pinning", "note", text("'", F.col("name"), "' ", F.col("why")))


def noops(t: Store, c: Config) -> DataFrame:
    e = t.flags().where(F.col("cmd_lower").isin(list(PAYLOADS))).where("in_source and not in_try and node_id is not null")
    e = e.where((F.col("cmd_lower") != "list") | F.get("args", F.lit(0)).isin("APPEND", "PREPEND"))
    pairs = F.arrays_zip("args", F.when(F.size("kinds") == F.size("args"), F.col("kinds")).otherwise(F.transform("args", lambda a: F.lit("bare"))).alias("kinds"))
    count = F.lit(None).cast("int")
    for cmd, (head, words) in PAYLOADS.items():
        rest = F.slice(pairs, head + 1, F.greatest(F.size("args") - head, F.lit(0)))
        real = F.filter(rest, lambda p: ~p["args"].isin(words) & ((p["args"] != "") | (p["kinds"] != "bare")) if words else (p["args"] != "") | (p["kinds"] != "bare"))
        count = F.when((F.col("cmd_lower") == cmd) & (F.size("args") >= head), F.size(real)).otherwise(count)
    e = e.withColumn("payload", count)
    acts = t.tgt_edges.select("recording", F.col("origin_event").alias("event_id")).unionByName(t.usage_reqs.select("recording", F.col("origin_event").alias("event_id"))).distinct().withColumn("acts", F.lit(True))
    e = e.join(acts, ["recording", "event_id"], "left")
    g = e.groupBy("recording", "file", "node_id", "line", "cmd_lower", "args_text").agg(F.max(F.coalesce("payload", F.lit(1))).alias("most"), F.max(F.coalesce("acts", F.lit(False)) & (F.col("cmd_lower") != "list")).alias("acts"), F.count("*").alias("n")).where("most = 0 and not acts")
    why = F.when(F.col("args_text").contains("${"), "its arguments expanded to nothing").otherwise("it has no arguments that add anything")
    return finding(g, "noop-calls", "note", text(F.col("cmd_lower"), "() does nothing in ", F.col("n"), " evaluations: ", why))
