"""Rules on variables: what is read, written and in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracemill import session
from tracemill.functions import text as X
from tracemill.rules.base import Config, Store, finding, first, text
from tracemill.rules.dead import declared_options

# Environment names that a build may expect, by name and by prefix.
AMBIENT = ["PATH", "HOME", "USER", "TMPDIR", "TEMP", "TMP", "PWD", "SHELL", "HOSTNAME", "NUMBER_OF_PROCESSORS", "ProgramFiles", "ProgramFiles(x86)", "ProgramW6432", "SystemRoot", "SYSTEMROOT", "WINDIR", "windir", "CC", "CXX", "CFLAGS", "CXXFLAGS", "LDFLAGS", "MAKEFLAGS", "VERBOSE", "DESTDIR", "CI"]
AMBIENT_PREFIXES = ["CMAKE_", "GITHUB_", "GITLAB_", "JENKINS_", "TRAVIS_", "BUILDKITE_"]
# Names that can't vary on one machine.
PLATFORM = ["WIN32", "WIN64", "APPLE", "UNIX", "LINUX", "CYGWIN", "MSYS", "MINGW", "ANDROID", "IOS", "BSD", "AIX", "HAIKU", "EMSCRIPTEN", "MSVC", "MSVC_IDE", "MSVC_VERSION", "MSVC_TOOLSET_VERSION", "BORLAND", "XCODE", "GHSMULTI"]
SHOWN = 60


def option_after_use(t: Store, c: Config) -> DataFrame:
    """Options whose name the project's text used before the declaration. All early uses are held against the reads; none is left out before."""
    d = declared_options(t).where("not in_try").where(~c.ignored("option-after-use", F.col("name")))
    guard = F.exists("blocks", lambda b: (b["kind"] == "if_condition") & F.array_contains(F.split(b["head"], r"[^A-Za-z0-9_]+"), F.col("name")))
    d = d.where(~F.coalesce(guard, F.lit(False))).select("recording", "name", "event_id", "file", "line")
    uses = t.static_refs().join(t.flags().where("not in_try").select("recording", "file", "node_id", F.col("event_id").alias("use_event")), ["recording", "file", "node_id"])
    uses = uses.select("recording", "name", "use_event", F.col("file").alias("use_file"), F.col("line").alias("use_line"))
    early = d.join(uses, ["recording", "name"]).where("use_event < event_id")
    read = t.var_reads.groupBy("recording", "name", F.col("event_id").alias("use_event")).agg(
        F.max(F.col("resolved_write_id").isNotNull() | (F.col("read_kind") == "condition")).alias("fine"), F.max(F.col("resolved_write_id").isNull() & (F.col("read_kind") == "expand")).alias("unset"))
    early = early.join(read, ["recording", "name", "use_event"], "left").where(~F.coalesce("fine", F.lit(False)))
    g = early.groupBy("recording", "name", "file", "line").agg(F.max(F.coalesce("unset", F.lit(False))).alias("unset"), F.min(F.struct("use_event", "use_file", "use_line")).alias("u"))
    related = F.array(F.struct(F.col("u.use_file").alias("file"), F.col("u.use_line").alias("line"), F.lit("first use, before the declaration").alias("note")))
    return finding(g, "option-after-use", F.when(F.col("unset"), "warning").otherwise("note"), text("option '", F.col("name"), "' is declared after its first use"), related=related)


def undefined_reads(t: Store, c: Config) -> DataFrame:
    r = t.at(t.var_reads.where("read_kind = 'expand' and resolved_write_id is null")).where("in_source").join(t.names("var_writes"), ["recording", "name"], "left_anti")
    targets = t.commands.where(F.col("name_lower").isin("set", "option", "list", "string") & (F.size("args") > 0))
    at = F.when(F.col("name_lower").isin("set", "option"), F.slice("args.value", 1, 1)).otherwise(F.slice("args.value", 2, 4))
    r = r.join(targets.select("recording", F.explode(at).alias("name")).distinct(), ["recording", "name"], "left_anti").where(~c.ignored("undefined-reads", F.col("name")))
    g = r.groupBy("recording", "name").agg(F.min(F.struct("event_id", "file", "line")).alias("f"), F.countDistinct("file", "node_id").alias("n")).select("recording", "name", "f.*", "n")
    # suggestions: names of nearly the same length in the same recording, by blocks of length
    known = t.names("var_writes").where("length(name) >= 4").select("recording", F.col("name").alias("known"), F.length("name").alias("len"))
    near = g.select("recording", "name", F.explode(F.sequence(F.length("name") - 2, F.length("name") + 2)).alias("len")).join(known, ["recording", "len"])
    near = near.withColumn("d", F.levenshtein("name", "known", 2)).where("d >= 0").groupBy("recording", "name").agg(F.min(F.struct("d", "known")).alias("best"))
    g = g.join(near, ["recording", "name"], "left")
    hint = F.when(F.col("best").isNotNull(), text("; did you mean '", F.col("best.known"), "'?")).otherwise("")
    return finding(g, "undefined-reads", "note", text("'", F.col("name"), "' is read but never written (", F.col("n"), " places)", hint))


def constant_conditions(t: Store, c: Config) -> DataFrame:
    e = t.flags().where(F.col("cmd_lower").isin("if", "elseif", "while")).where("in_source and node_id is not null and not in_try and size(args) > 0")
    writes = t.at(t.var_writes, prefix="w_").select("recording", F.col("write_id").alias("resolved_write_id"), F.col("value"), F.col("w_cmd_lower").alias("writer"))
    reads = t.var_reads.where(F.col("read_kind").isin("expand", "condition")).join(e.select("recording", "event_id"), ["recording", "event_id"], "left_semi").join(writes, ["recording", "resolved_write_id"], "left")
    # a value that the trace doesn't show is told apart by the write itself
    state = F.struct("name", "read_id", F.coalesce(F.concat(F.lit("="), F.col("value")), F.concat(F.lit("#"), F.col("resolved_write_id").cast("string")), F.lit("-")).alias("v"))
    seen = reads.groupBy("recording", "event_id").agg(F.sort_array(F.collect_list(state)).alias("s"), F.max(F.coalesce(F.col("writer") == "foreach", F.lit(False))).alias("loop"))
    seen = seen.withColumn("s", F.transform("s", lambda r: F.struct(r["name"], r["v"])).cast("string"))
    e = e.join(seen, ["recording", "event_id"], "left")
    # an argument that is itself a written name, but not in the text, is read a second time
    words = e.select("recording", "event_id", "args_text", F.explode("args").alias("name")).where("name rlike '^[A-Za-z_][A-Za-z0-9_]*$'").where(~F.array_contains(F.split("args_text", r"\s+"), F.col("name")))
    twice = words.join(t.names("var_writes"), ["recording", "name"], "left_semi").select("recording", "event_id").distinct().withColumn("twice", F.lit(True)).transform(session.dealt)
    e = e.join(twice, ["recording", "event_id"], "left")
    g = e.groupBy("recording", "file", "node_id", "line").agg(
        F.count("*").alias("n"), F.countDistinct("args_json").alias("a"), F.countDistinct(F.coalesce("s", F.lit(""))).alias("v"),
        F.max(F.coalesce("loop", F.lit(False))).alias("loop"), F.max(F.coalesce("twice", F.lit(False))).alias("twice"), F.min("args_text").alias("text"))
    g = g.where("n >= 3 and a = 1 and v = 1 and not loop and not twice")
    name = F.col("name")
    told = t.static_refs().where(~name.isin(PLATFORM) & ~c.ignored("constant-conditions", name)).join(t.names("var_writes"), ["recording", "name"], "left_semi").select("recording", "file", "node_id").distinct().transform(session.dealt)
    g = g.join(told, ["recording", "file", "node_id"], "left_semi")
    return finding(g, "constant-conditions", "note", text("condition `", X.shorten(F.col("text"), SHOWN), "` had the same inputs in all ", F.col("n"), " evaluations"))


def env_dependence(t: Store, c: Config) -> DataFrame:
    n = F.col("name")
    expected = n.isin(AMBIENT)
    for p in AMBIENT_PREFIXES:
        expected |= n.startswith(p)
    r = t.at(t.var_reads.where("read_kind = 'env' and resolved_write_id is null")).where("in_source and not in_try").where(~expected & ~c.ignored("env-dependence", n))
    places = first(r, ["name", "file", "line"])
    ranked = places.withColumn("_k", F.row_number().over(W.partitionBy("recording", "name").orderBy("event_id")))
    more = ranked.where("_k between 2 and 5").groupBy("recording", "name").agg(F.array_sort(F.collect_list(F.struct("file", F.col("line").alias("line"), F.lit("read here too").alias("note")))).alias("related"))
    counts = r.groupBy("recording", "name").agg(F.count("*").alias("n"))
    d = ranked.where("_k = 1").join(counts, ["recording", "name"]).join(more, ["recording", "name"], "left")
    return finding(d, "env-dependence", "note", text("the environment variable '", n, "' is read ", F.col("n"), " times and set by nothing in the build"), related=F.coalesce("related", F.array()))


def clobbers(t: Store, c: Config) -> DataFrame:
    w = t.var_writes.where("scope_id is not null and write_kind = 'set'")
    nxt = W.partitionBy("recording", "scope_id", "name").orderBy("write_id")
    w = w.withColumns({"next_event": F.lead("event_id").over(nxt), "next_value": F.lead("value").over(nxt)}).where("value <> next_value")
    seen = t.var_reads.where("resolved_write_id is not null").select("recording", F.col("resolved_write_id").alias("write_id")).distinct()
    w = w.join(seen, ["recording", "write_id"], "left_anti").where(~c.ignored("clobbers", F.col("name")))
    w = t.at(t.at(w), "next_event", "n_").where("in_source and n_in_source and not in_loop and not n_in_loop")
    w = w.where(~((F.col("file") == F.col("n_file")) & F.coalesce(F.col("node_id") == F.col("n_node_id"), F.lit(False))))
    related = F.array(F.struct(F.col("n_file").alias("file"), F.col("n_line").alias("line"), F.lit("overwritten here").alias("note")))
    return finding(w, "clobbers", "warning", text("'", F.col("name"), "' = '", X.shorten(F.col("value"), SHOWN), "' is overwritten with '", X.shorten(F.col("next_value"), SHOWN), "' before any read"), related=related)


def scope_leaks(t: Store, c: Config) -> DataFrame:
    w = t.at(t.var_writes)
    other = w.where("scope_kind <> 'macro' and scope_id is not null").select("recording", "scope_id", "name").distinct().withColumn("clash", F.lit(True))
    leaks = w.where("scope_kind = 'macro' and write_kind = 'set' and in_source").where(~c.ignored("scope-leaks", F.col("name")))
    d = first(leaks, ["scope_name", "name"], "write_id").join(other, ["recording", "scope_id", "name"], "left")
    opener = t.events.select("recording", F.col("event_id").alias("opened_by_event"), F.col("file").alias("o_file"), F.col("line").alias("o_line"))
    d = d.join(opener, ["recording", "opened_by_event"], "left")
    related = F.when(F.col("o_file").isNotNull(), F.array(F.struct(F.col("o_file").alias("file"), F.col("o_line").alias("line"), F.lit("the macro's call").alias("note")))).otherwise(F.array())
    hint = F.when(F.col("clash"), ", which writes that name too").otherwise("")
    return finding(d, "scope-leaks", F.when(F.col("clash"), "warning").otherwise("note"), text("macro '", F.col("scope_name"), "' leaves '", F.col("name"), "' in its caller", hint), related=related)


def single_use(t: Store, c: Config) -> DataFrame:
    n = F.col("name")
    once = t.var_writes.groupBy("recording", "name").agg(F.count("*").alias("n"), F.first("write_id").alias("write_id"), F.first("event_id").alias("event_id"), F.first("write_kind").alias("k")).where("n = 1 and k = 'set'")
    read = t.var_reads.groupBy("recording", "name").agg(F.count("*").alias("n"), F.first("event_id").alias("read_event"), F.first("resolved_write_id").alias("write_id"), F.first("read_kind").alias("rk")).where("n = 1 and rk in ('expand', 'listarg')")
    d = once.drop("n", "k").join(read.drop("n", "rk"), ["recording", "name", "write_id"]).where(~n.startswith("CMAKE_") & ~n.startswith("_CMAKE_") & ~c.ignored("single-use-variables", n))
    d = t.at(t.at(d), "read_event", "r_").where("in_source and r_in_source and cmd_lower = 'set' and not in_loop and not in_try and not r_in_try and not in_callable and not r_in_callable")
    refs = t.static_refs().groupBy("recording", "name").agg(F.countDistinct("file", "node_id").alias("refs"))
    d = d.join(refs, ["recording", "name"], "left").where(F.coalesce("refs", F.lit(0)) <= F.when(F.col("r_node_id").isNotNull(), 1).otherwise(0))
    writers = t.cold().where(F.col("name_lower").isin("set", "option", "list", "string", "foreach", "unset")).select("recording", F.explode("args.value").alias("name")).distinct()
    d = d.join(writers, ["recording", "name"], "left_anti")
    related = F.array(F.struct(F.col("r_file").alias("file"), F.col("r_line").alias("line"), F.lit("its only read").alias("note")))
    return finding(d, "single-use-variables", "note", text("'", n, "' is set once and read once; its value could stand there"), related=related)


def aliases(t: Store, c: Config) -> DataFrame:
    """set(X ${Y}) where X is another name for Y throughout; and set(V ${V} PARENT_SCOPE) in a function whose V comes from outside it, every time."""
    n = F.col("name")
    w = t.at(t.var_writes.where("write_kind in ('set', 'parent_scope')")).where("in_source and not in_try").where(~c.ignored("alias-variables", n))
    source = F.regexp_extract("args_text", r"^(\S+) \$\{([A-Za-z0-9_]+)\}$", 2)
    one = w.where("write_kind = 'set' and cmd_lower = 'set' and not in_loop").withColumn("of", source).where("of <> '' and of <> name")
    count = t.var_writes.groupBy("recording", "name").agg(F.count("*").alias("n")).where("n = 1").select("recording", "name")
    later = t.var_writes.groupBy("recording", F.col("name").alias("of")).agg(F.max("write_id").alias("last"))
    stray = t.var_reads.select("recording", "name", "resolved_write_id").join(one.select("recording", "name", "write_id"), ["recording", "name"]).where("resolved_write_id is null or resolved_write_id <> write_id").select("recording", "name").distinct().transform(session.dealt)
    read = t.names("var_reads")
    one = one.join(count, ["recording", "name"], "left_semi").join(read, ["recording", "name"], "left_semi").join(stray, ["recording", "name"], "left_anti").join(later, ["recording", "of"]).where("last < write_id")
    a = finding(one, "alias-variables", "note", text("'", n, "' is only another name for '", F.col("of"), "'"))
    back = w.where("write_kind = 'parent_scope' and scope_kind = 'function'").where(F.col("args_text") == F.concat(n, F.lit(" ${"), n, F.lit("} PARENT_SCOPE")))
    home = t.var_writes.select("recording", F.col("write_id").alias("resolved_write_id"), F.col("scope_id").alias("home"))
    here = t.events.select("recording", "event_id", F.col("scope_id").alias("here"))
    got = t.var_reads.where("read_kind = 'expand' and resolved_write_id is not null").join(home, ["recording", "resolved_write_id"]).join(here, ["recording", "event_id"]).groupBy("recording", "event_id", "name").agg(F.max(F.coalesce(F.col("home") != F.col("here"), F.lit(True))).alias("outside"))
    back = back.join(got, ["recording", "event_id", "name"], "left").groupBy("recording", "file", "line", "name").agg(F.min(F.coalesce("outside", F.lit(False))).alias("always")).where("always")
    return a.unionByName(finding(back, "alias-variables", "note", text("'", n, "' is handed back to the caller it came from")))
