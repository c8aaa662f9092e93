"""The build graph as the generator resolved it: the reply files of the file API."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import session

_OUT = "target string, type string, what string, kind string, value string, file string, line bigint"
HOPS = 64


def _place(graph: dict, at: int | None) -> tuple[str | None, int | None]:
    """The nearest place with a line on the way to the root."""
    nodes, files = graph.get("nodes", []), graph.get("files", [])
    for _ in range(HOPS):
        if at is None or not 0 <= at < len(nodes):
            break
        n = nodes[at]
        if "line" in n and "file" in n:
            return files[n["file"]], n["line"]
        at = n.get("parent")
    return None, None


def _rows(text: str) -> list[tuple]:
    """A target's row, its requirements (each once for a kind, value and place), and its translation units."""
    t = json.loads(text)
    graph, name, kind = t.get("backtraceGraph", {}), t["name"], t.get("type")
    place = lambda x: _place(graph, x.get("backtrace"))
    found = [("target", None, None, *place(t))]
    for g in t.get("compileGroups", []):
        found += [("req", "include", i["path"], *place(i)) for i in g.get("includes", [])]
        found += [("req", "define", d["define"], *place(d)) for d in g.get("defines", [])]
        found += [("req", "option", f["fragment"].strip(), *place(f)) for f in g.get("compileCommandFragments", [])]
    found += [("req", "link", f["fragment"].strip(), *place(f)) for f in t.get("link", {}).get("commandFragments", []) if f.get("role") == "libraries"]
    found += [("tu", None, s["path"], None, None) for s in t.get("sources", []) if "compileGroupIndex" in s]
    return [(name, kind, *r) for r in dict.fromkeys(found)]


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _OUT.split(", ")]
    for b in batches:
        yield pd.DataFrame([r for text in b["value"] for r in _rows(text)], columns=names).astype({"line": "Int64"})


def _small(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def read(spark: SparkSession, folder: str, recording: str, source_dir: str, events: DataFrame) -> dict[str, DataFrame]:
    """targets, usage_reqs and tus of a reply folder: its newest index, and of its code model the first configuration. Places are matched to the first event there."""
    session.ship(spark)
    index = spark.read.text(f"{folder}/index-*.json", wholetext=True).select(F.col("_metadata.file_path").alias("p")).orderBy(F.desc("p")).first()
    if index is None:
        raise ValueError(f"{folder} has no index")
    model = next((o["jsonFile"] for o in _small(spark, index.p)["objects"] if o.get("kind") == "codemodel"), None)
    if model is None:
        raise ValueError(f"{folder} has no code model")
    files = [f"{folder}/{t['jsonFile']}" for t in _small(spark, f"{folder}/{model}")["configurations"][0]["targets"]]
    full = lambda c: F.when(F.col(c).startswith("/"), F.col(c)).otherwise(F.concat(F.lit(source_dir.rstrip("/") + "/"), F.col(c)))
    rows = spark.read.text(files, wholetext=True).mapInPandas(_batches, _OUT).withColumns({"recording": F.lit(recording), "file": full("file")})
    at = events.where(F.col("recording") == recording).groupBy("file", "line").agg(F.min("event_id").alias("origin_event"))
    placed = rows.join(at, ["file", "line"], "left")
    return {
        "targets": placed.where("what = 'target'").select("recording", F.col("target").alias("name"), "type", F.lit(0).alias("imported"), F.lit(None).cast("string").alias("alias_of"), F.col("origin_event").alias("defined_event"), F.lit(1).alias("in_file_api")),
        "usage_reqs": placed.where("what = 'req' and value <> ''").select("recording", "target", "kind", "value", F.lit(None).cast("string").alias("visibility"), F.lit("fileapi").alias("source"), "origin_event").distinct(),
        "tus": rows.where("what = 'tu'").select("recording", "target", full("value").alias("source_path")),
    }


def merge(targets: DataFrame, replied: DataFrame) -> DataFrame:
    """Targets of the trace and of the reply, one row a name: the reply's type goes first, the trace's place does."""
    a, b = targets.alias("a"), replied.alias("b")
    j = a.join(b, (F.col("a.recording") == F.col("b.recording")) & (F.col("a.name") == F.col("b.name")), "full")
    pick = lambda c, first, second: F.coalesce(f"{first}.{c}", f"{second}.{c}").alias(c)
    return j.select(pick("recording", "a", "b"), pick("name", "a", "b"), pick("type", "b", "a"), pick("imported", "a", "b"), pick("alias_of", "a", "b"), pick("defined_event", "a", "b"), pick("in_file_api", "b", "a"))

