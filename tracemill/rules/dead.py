"""What is declared and never used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.rules.base import Config, Store, after, finding, first, sites, text

#: Cache types that a user edits.
USER_TYPES = ["BOOL", "STRING", "PATH", "FILEPATH"]
RELATED = 5


def declared_options(t: Store) -> DataFrame:
    """First declaration of each cache name by option() or set(... CACHE <user type>), with the flags of its event. Files outside the project count in the order, as a declaration there hides a later one."""
    e = t.flags().where((F.col("cmd_lower") == "option") | ((F.col("cmd_lower") == "set") & after("args", "CACHE").isin(USER_TYPES)))
    e = e.where(F.size("args") > 0).withColumn("name", F.col("args")[0])
    return first(e, ["name"]).where("in_source")


def _presets(t: Store, rows: DataFrame, name: str) -> DataFrame:
    """rows whose name no preset text of their recording holds."""
    if t.meta is None:
        return rows
    texts = t.meta.where(F.col("key").isin("presets_json", "user_presets_json")).select("recording", F.col("value").alias("_preset"))
    return rows.join(texts, (texts.recording == rows.recording) & F.col("_preset").contains(F.col(name)), "left_anti")


def options(t: Store, c: Config) -> DataFrame:
    d = declared_options(t).join(t.names("var_reads"), ["recording", "name"], "left_anti")
    d = _presets(t, d.where(~c.ignored("dead-options", F.col("name"))), "name")
    cold = t.static_refs().join(t.cold().select("recording", "file", "node_id"), ["recording", "file", "node_id"], "left_semi")
    d = d.join(sites(cold, ["name"], RELATED, "a reference that never ran"), ["recording", "name"], "left")
    hint = F.when(F.col("related").isNotNull(), "; the text that refers to it never ran").otherwise("")
    return finding(d, "dead-options", "warning", text("option '", F.col("name"), "' is never read", hint), related=F.coalesce("related", F.array()))


def functions(t: Store, c: Config) -> DataFrame:
    d = t.at(t.func_defs.drop("file", "line", "kind").join(t.func_defs.select("recording", "def_id", F.col("kind").alias("def_kind")), ["recording", "def_id"]))
    d = first(d.where("in_source").where(~c.ignored("dead-functions", F.col("name"))), ["name_lower"])
    called = t.events.where(~F.col("cmd_lower").isin("function", "macro")).select("recording", F.col("cmd_lower").alias("name_lower"))
    spoken = t.events.where((F.col("cmd_lower") == "cmake_language") & F.upper(F.get("args", F.lit(0))).isin("CALL", "DEFER"))
    spoken = spoken.select("recording", F.explode(F.transform(F.slice("args", 2, 3), F.lower)).alias("name_lower"))
    d = d.join(called.unionByName(spoken).distinct(), ["recording", "name_lower"], "left_anti")
    cold = t.cold().select("recording", "name_lower", "file", "line")
    d = d.join(sites(cold, ["name_lower"], RELATED, "a call that never ran"), ["recording", "name_lower"], "left")
    hint = F.when(F.col("related").isNotNull(), "; it is called only where nothing ran").otherwise("")
    return finding(d, "dead-functions", "warning", text(F.col("def_kind"), " '", F.col("name"), "' is never called", hint), related=F.coalesce("related", F.array()))


def modules(t: Store, c: Config) -> DataFrame:
    f = t.files.where("in_source = 1").select("recording", F.col("path").alias("file"), F.substring_index("path", "/", -1).alias("name"))
    f = f.join(t.events.select("recording", "file").distinct(), ["recording", "file"], "left_anti").where(~c.ignored("dead-modules", F.col("name")))
    # build files end in .cmake or CMakeLists.txt: an argument holds a name where one of its parts up to such an end does
    said = t.events.select("recording", F.explode("args").alias("a")).select("recording", F.lower("a").alias("a")).where("a like '%.cmake%' or a like '%cmakelists.txt%'").distinct()
    parts = F.split("a", r"(?<=\.cmake)|(?<=cmakelists\.txt)")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ""))
    lengths = f.groupBy("recording").agg(F.collect_set(F.char_length("name")).alias("lengths"))
    ends = said.select("recording", F.explode(upto).alias("p")).distinct().join(lengths, "recording").select("recording", "p", F.explode("lengths").alias("n"))
    spoken = ends.select("recording", F.expr("right(p, n)").alias("spoken")).distinct()
    f = f.withColumn("spoken", F.lower("name")).join(spoken, ["recording", "spoken"], "left_anti")
    f = _presets(t, f, "name").withColumn("line", F.lit(1))
    why = F.when(F.col("name") == "CMakeLists.txt", "its folder is never added").otherwise("it is never included")
    return finding(f, "dead-modules", "warning", text("'", F.col("name"), "' never ran: ", why))


def variables(t: Store, c: Config) -> DataFrame:
    w = t.at(t.var_writes.where(F.col("write_kind").isin("set", "parent_scope"))).where("in_source and cmd_lower = 'set'")
    w = w.join(t.names("var_reads"), ["recording", "name"], "left_anti").where(~c.ignored("dead-variables", F.col("name")))
    refs = sites(t.static_refs(), ["name"], RELATED, "a reference that never ran")
    w = first(w, ["name"]).join(refs, ["recording", "name"], "left")
    severity = F.when(F.col("related").isNotNull(), "note").otherwise("warning")
    return finding(w, "dead-variables", severity, text("variable '", F.col("name"), "' is set and never read"), related=F.coalesce("related", F.array()))
