"""Findings as text, JSON and SARIF; baselines, gates and sets over recordings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import model
from tracemill.functions.text import fnv1a
from tracemill.operators import compare

#: What a finding is, whatever its wording and severity.
KEY = ["rule", "file", "line"]
VERSION = 1
LEVELS = {"note": "note", "warning": "warning", "error": "error"}


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("recording", "file", "line", "rule", "message")


def rank(severity):
    return F.array_position(F.array(*[F.lit(s) for s in model.SEVERITIES]), severity)


def gate(findings: DataFrame, at_least: str = "warning") -> int:
    """Exit code: 1 if any finding is as severe, else 0."""
    return int(not findings.where(rank(F.col("severity")) >= model.SEVERITIES.index(at_least) + 1).isEmpty())


def in_all(findings: DataFrame) -> DataFrame:
    """Findings of the first recording that every recording has, with their number in the message."""
    n = findings.select("recording").distinct().count()
    keys = findings.groupBy(*KEY).agg(F.countDistinct("recording").alias("n"), F.min("recording").alias("recording")).where(F.col("n") == n).drop("n")
    return findings.join(keys, ["recording", *KEY]).withColumn("message", F.concat("message", F.lit(f" (in all {n} recordings)"))).select(*findings.columns)


def baseline(findings: DataFrame) -> str:
    rows = findings.select(*KEY).distinct().orderBy(*KEY).collect()
    return json.dumps({"baseline_version": VERSION, "findings": [r.asDict() for r in rows]}, indent=1)


def not_in_baseline(spark: SparkSession, findings: DataFrame, text: str) -> DataFrame:
    """ValueError if the baseline is of another version."""
    data = json.loads(text)
    if data.get("baseline_version") != VERSION:
        raise ValueError(f"baseline version {data.get('baseline_version')}, not {VERSION}")
    known = spark.createDataFrame([tuple(f[k] for k in KEY) for f in data["findings"]], "rule string, file string, line bigint")
    return compare.not_in_baseline(findings, known, KEY)


def as_text(findings: DataFrame) -> str:
    """One line a finding and one for each related place. A report is for reading: rows come to the driver one partition at a time."""
    out = []
    for f in ordered(findings).toLocalIterator():
        out.append(f"{f.file}:{f.line}: {f.severity}: {f.message} [{f.rule}]")
        out += [f"    {r.file}:{r.line}: {r.note}" for r in f.related]
    return "\n".join([*out, f"{sum(not o.startswith('    ') for o in out)} findings"])


def as_json(findings: DataFrame) -> DataFrame:
    """One JSON object a row, for writing as text."""
    return ordered(findings).select(F.to_json(F.struct(F.lit(VERSION).alias("version"), *findings.columns)).alias("value"))


def sarif(findings: DataFrame, tool: str = "tracemill") -> str:
    """SARIF 2.1.0 with fingerprints over rule, file and line; places that are no files don't appear as related."""
    rows = ordered(findings).withColumn("print", fnv1a(F.concat_ws("\u0000", *KEY))).collect()

    def place(file, line, note=None):
        at = {"physicalLocation": {"artifactLocation": {"uri": file}} | ({"region": {"startLine": line}} if line > 0 else {})}
        return at | ({"message": {"text": note}} if note else {})

    results = [
        {"ruleId": f.rule, "level": LEVELS[f.severity], "message": {"text": f.message}, "locations": [place(f.file, f.line)], "partialFingerprints": {"place/v1": str(f.print)},
         "relatedLocations": [place(r.file, r.line, r.note) for r in f.related if not r.file.startswith("<")]} for f in rows]
    driver = {"name": tool, "rules": [{"id": r} for r in sorted({f.rule for f in rows})]}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": driver}, "results": results}]}, indent=1)


def folded(stacks: DataFrame) -> DataFrame:
    """Lines of a flame graph: stack and microseconds, in the order of their bytes."""
    return stacks.groupBy("stack").agg(F.sum("self_us").alias("n")).where("n > 0").orderBy("stack").select(F.concat_ws(" ", "stack", F.col("n").cast("string")).alias("value"))


def _quote(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'


def dot(edges: DataFrame) -> str:
    """A link graph (src, dst, visibility) for Graphviz."""
    rows = edges.select("src", "dst", "visibility").distinct().orderBy("src", "dst", "visibility").collect()
    return "\n".join(["digraph links {", *(f"  {_quote(r.src)} -> {_quote(r.dst)} [label={_quote(r.visibility)}];" for r in rows), "}"])


def mermaid(edges: DataFrame) -> str:
    rows = edges.select("src", "dst", "visibility").distinct().orderBy("src", "dst", "visibility").collect()
    names = {n: f"n{i}" for i, n in enumerate(sorted({r.src for r in rows} | {r.dst for r in rows}))}
    safe = lambda s: s.replace('"', "&quot;")
    return "\n".join(["graph LR", *(f'  {i}["{safe(n)}"]' for n, i in names.items()), *(f"  {names[r.src]} -->|{r.visibility}| {names[r.dst]}" for r in rows)])


def tab_separated(rows: DataFrame) -> str:
    """A query's rows with a header; null as NULL."""
    line = lambda values: "\t".join("NULL" if v is None else str(v) for v in values)
    return "\n".join([line(rows.columns), *(line(r) for r in rows.toLocalIterator())])


def graph_json(edges: DataFrame) -> str:
    """The link graph as nodes and edges."""
    rows = edges.select("src", "dst", "visibility").distinct().orderBy("src", "dst", "visibility").collect()
    return json.dumps({"nodes": sorted({r.src for r in rows} | {r.dst for r in rows}), "edges": [r.asDict() for r in rows]}, indent=1)


def as_objects(rows: DataFrame) -> DataFrame:
    """Answers of questions as one JSON object a row, nulls kept."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def bill_of_materials(dependencies: DataFrame, project: str, version: str = "1") -> str:
    """CycloneDX 1.5 of questions.dependencies, in the order of their places. A version is given only where it is exact: a full commit. Packages that were not found are in it, marked so."""
    components = []
    for d in dependencies.orderBy("file", "line", "name").collect():
        exact = d.how != "find_package" and d.problem is None and d.version
        said = {"mechanism": d.how, "declared-at": f"{d.file}:{d.line}", "required": d.required, "found": d.found, "requested-version": d.version, "source": d.source, "problem": d.problem}
        text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
        one = {"type": "library", "name": d.name, "properties": [{"name": f"tracemill:{k}", "value": text(v)} for k, v in said.items() if v is not None]}
        components.append(one | ({"version": d.version} if exact else {}) | ({"purl": d.purl} if d.purl else {}))
    about = {"tools": {"components": [{"type": "application", "name": "tracemill", "version": version}]}, "component": {"type": "application", "name": project}}
    return json.dumps({"bomFormat": "CycloneDX", "specVersion": "1.5", "version": 1, "metadata": about, "components": components}, indent=1)
