"""Rewrites of directory commands into commands of the targets they reach: planned as edits, applied behind a check of the content."""

from __future__ import annotations

import difflib
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill import session
from tracemill.rules.base import Store, text

# The legacy command, its form for one target, and the kind of its resolved rows.
REWRITES = {
    "include_directories": ("target_include_directories", "include"), "add_definitions": ("target_compile_definitions", "define"),
    "add_compile_options": ("target_compile_options", "option"), "link_libraries": ("target_link_libraries", "link"),
}
NOT_UNDERSTOOD = ["SYSTEM", "BEFORE", "AFTER", "debug", "optimized", "general", ""]
EDITS = "recording string, file string, byte_start bigint, byte_end bigint, text string, content_hash string"


def _own_directory():
    """The directory scope of a call if its nearest scope with a variable table is one, else null."""
    opaque = F.filter(F.reverse("chain"), lambda s: ~F.substring_index(s, ":", -1).isin("macro", "include", "unknown"))
    top = F.get(opaque, F.lit(0))
    return F.when(F.substring_index(top, ":", -1) == "directory", F.substring_index(top, ":", 1).cast("long"))


def candidates(t: Store) -> DataFrame:
    """Legacy calls of the project, one row a place, with problem: why it stays as it is, else null; values and dir_scope."""
    e = t.flags().where(F.col("cmd_lower").isin(list(REWRITES))).where("in_source and node_id is not null and not in_try")
    g = e.groupBy("recording", "file", "line", "node_id", "cmd_lower").agg(F.countDistinct("args_json").alias("sets"), F.min_by("args", "event_id").alias("args"), F.min("event_id").alias("event_id"), F.min_by(_own_directory(), "event_id").alias("dir_scope"), F.countDistinct("scope_id").alias("scopes"))
    g = g.withColumn("values", F.flatten(F.transform("args", lambda a: F.split(a, ";"))))
    odd = F.exists("values", lambda v: v.isin(NOT_UNDERSTOOD) | v.contains("$<") | v.contains('"') | v.contains("\\"))
    no_define = (F.col("cmd_lower") == "add_definitions") & ~F.forall("values", lambda v: v.startswith("-D"))
    problem = F.when(F.col("sets") > 1, "its arguments differ between evaluations").when(F.col("dir_scope").isNull() | (F.col("scopes") > 1), "it doesn't run in one directory's scope").when(odd | no_define | (F.size("values") == 0), "its arguments aren't understood")
    return g.withColumn("problem", problem)


def plan(t: Store) -> DataFrame:
    """Edits (EDITS) of every call that can be rewritten: the call goes, and each target made later below its directory gets its own call, if the resolved build shows every value there.

    rule and line name the call; the rows with problem say why a call stays and carry no edit.
    """
    c = candidates(t)
    kind = F.create_map(*[F.lit(x) for k, v in REWRITES.items() for x in (k, v[1])])[F.col("cmd_lower")]
    new = F.create_map(*[F.lit(x) for k, v in REWRITES.items() for x in (k, v[0])])[F.col("cmd_lower")]
    open_ = c.where("problem is null").withColumns({"kind": kind, "new": new}).withColumn("values", F.when(F.col("cmd_lower") == "add_definitions", F.transform("values", lambda v: F.regexp_replace(v, "^-D", ""))).otherwise(F.col("values")))
    made = t.targets.where("imported = 0 and alias_of is null and coalesce(type, '') not in ('UTILITY', 'INTERFACE')").select("recording", F.col("name").alias("target"), F.col("defined_event").alias("event_id"))
    made = made.join(t.flags().select("recording", "event_id", F.col("file").alias("t_file"), F.col("node_id").alias("t_node"), "chain"), ["recording", "event_id"])
    made = made.select("recording", "target", F.col("event_id").alias("made"), "t_file", "t_node", F.explode(F.transform("chain", lambda s: F.substring_index(s, ":", 1).cast("long"))).alias("dir_scope"))
    hit = open_.join(made, ["recording", "dir_scope"]).where("made > event_id")
    state = t.usage_reqs.where("source = 'fileapi'").groupBy("recording", "target", "kind").agg(F.collect_set(F.when(F.col("kind") == "include", F.regexp_replace("value", "/+$", "")).otherwise(F.col("value"))).alias("state"))
    hit = hit.join(state, ["recording", "target", "kind"], "left").withColumn("state", F.coalesce("state", F.array().cast("array<string>")))
    by_part = F.forall("values", lambda v: F.exists("state", lambda s: s.contains(v)))
    exact = F.forall("values", lambda v: F.array_contains(F.col("state"), F.regexp_replace(v, "/+$", "")))
    hit = hit.withColumn("shown", F.when(F.col("kind").isin("option", "link"), by_part).otherwise(exact))
    place = ["recording", "file", "node_id"]
    whole = hit.groupBy(*place).agg(F.min("shown").alias("shown"))
    good = hit.join(whole.where("shown").select(*place), place, "left_semi")
    cmd = t.commands.select("recording", F.col("file").alias("f"), F.col("node_id").alias("n"), "byte_start", "byte_end")
    hash_ = t.files.select("recording", F.col("path").alias("f"), "content_hash")
    gone = good.select(*place, "line", "cmd_lower").distinct().withColumns({"f": F.col("file"), "n": F.col("node_id"), "text": F.lit("")}).join(cmd, ["recording", "f", "n"])
    line = text("\n", F.col("new"), "(", F.col("target"), " PRIVATE ", F.array_join("values", " "), ")")
    added = good.withColumns({"f": F.col("t_file"), "n": F.col("t_node"), "text": line}).join(cmd.withColumn("byte_start", F.col("byte_end")), ["recording", "f", "n"])
    cols = ["recording", F.concat(F.lit("modernize-"), F.col("cmd_lower")).alias("rule"), F.col("f").alias("file"), F.col("line").cast("bigint").alias("line"), F.lit(None).cast("string").alias("problem"), "byte_start", "byte_end", "text", "content_hash"]
    edits = gone.select("recording", "f", "cmd_lower", "line", "byte_start", "byte_end", "text").unionByName(added.select("recording", "f", "cmd_lower", "line", "byte_start", "byte_end", "text")).join(hash_, ["recording", "f"]).select(*cols)
    left = c.join(whole.where("shown").select(*place), place, "left_anti").withColumn("problem", F.coalesce("problem", F.lit("the resolved build doesn't show its values on the targets it reaches")))
    null = lambda t_: F.lit(None).cast(t_)
    return edits.unionByName(left.select("recording", F.concat(F.lit("modernize-"), F.col("cmd_lower")).alias("rule"), "file", F.col("line").cast("bigint").alias("line"), "problem", null("bigint").alias("byte_start"), null("bigint").alias("byte_end"), null("string").alias("text"), null("string").alias("content_hash")))


def apply_edits(data: bytes, edits: list[tuple[int, int, str]], content_hash: str) -> bytes:
    """data with (start, end, text) put in. ValueError if the content isn't that of the hash, or edits overlap; insertions at one place go in by their text's order."""
    if hashlib.sha256(data).hexdigest() != content_hash:
        raise ValueError("the file has changed since it was recorded")
    out, at = [], 0
    for start, end, new in sorted(set(edits)):
        if start < at or end > len(data):
            raise ValueError("edits overlap")
        out += [data[at:start], new.encode()]
        at = end
    return b"".join([*out, data[at:]])


def _patch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for r in b.itertuples(index=False):
            new = apply_edits(r.content.encode(), [(e["byte_start"], e["byte_end"], e["text"]) for e in r.edits], r.content_hash).decode()
            diff = "".join(difflib.unified_diff(r.content.splitlines(True), new.splitlines(True), f"a{r.path}", f"b{r.path}"))
            rows.append((r.recording, r.path, new, diff))
        yield pd.DataFrame(rows, columns=["recording", "path", "content", "diff"])


def patched(t: Store, edits: DataFrame) -> DataFrame:
    """recording, path, content, diff of each file that edits change."""
    session.ship(edits.sparkSession)
    by_file = edits.where("problem is null").groupBy("recording", F.col("file").alias("path")).agg(F.collect_list(F.struct("byte_start", "byte_end", "text")).alias("edits"))
    return t.files.select("recording", "path", "content", "content_hash").join(by_file, ["recording", "path"]).mapInPandas(_patch, "recording string, path string, content string, diff string")
