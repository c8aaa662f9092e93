"""Recordings on disk, questions and reports, on hand-written synthetic traces."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_replay import MAIN, SRC, STEPS, trace_lines
from tracemill import questions as Q
from tracemill import catalog, recording, report, rules
from tracemill.replay import crosscheck
from tracemill.sources import replies, trace


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    f = tmp_path_factory.mktemp("rec")
    for name, steps in (("one", STEPS), ("two", [*STEPS, (23, "add_library", ["extra", "SHARED"], 1)])):
        (f / name).mkdir()
        (f / name / "trace.jsonl").write_text(trace_lines(steps))
    src = spark.createDataFrame([(n, SRC, MAIN) for n in ("one", "two")], "recording string, path string, content string")
    t = recording.ingest(spark, [str(f / n / "trace.jsonl") for n in ("one", "two")], src, "/src", "/build")
    recording.save(t, str(f / "db"))
    return f


@pytest.fixture(scope="module")
def store(spark, folder):
    return rules.Store(recording.load(spark, str(folder / "db")))


def test_load_needs_events(spark, tmp_path):
    with pytest.raises(ValueError, match="is no recording"):
        recording.load(spark, str(tmp_path))


def test_bad_trace_leaves_nothing(spark, tmp_path):
    (tmp_path / "t").write_text("x\n")
    with pytest.raises(trace.TraceError):
        recording.ingest(spark, str(tmp_path / "t"), spark.createDataFrame([], "recording string, path string, content string"), "/src")


def test_why_value(store):
    rows = Q.why_value(store, "A").where("recording = 'one'").collect()
    assert [(r.line, r.value, r.write_kind, r.reads) for r in rows] == [(1, "1", "set", 0), (2, "2", "set", 1), (21, None, "unset", 0)]
    assert [r.value for r in Q.why_value(store, "A", "CMakeLists.txt", 3).where("recording = 'one'").collect()] == ["2"]


def test_why_links(store):
    assert {(r.recording, r.src, r.dst, r.visibility, r.line) for r in Q.why_links(store, "app", "core").collect()} == {(n, "app", "core", v, 20) for n in ("one", "two") for v in ("PRIVATE", "PUBLIC")}


def test_diff(store):
    assert {tuple(r) for r in Q.diff(store, "one", "two").collect()} == {("targets", "extra SHARED", "only_right")}
    assert Q.diff(store, "one", "one").count() == 0


def test_explain_and_why_not(store):
    r = Q.explain(store, "CMakeLists.txt", 7).where("recording = 'one'").collect()
    assert [(x.cmd, x.evaluations, x.writes) for x in r] == [("set", 1, 1)]
    s = {(x.line, x.status) for x in Q.why_not_run(store, "SET").where("recording = 'one'").collect()}
    assert s == {(1, "ran"), (2, "ran"), (7, "ran"), (8, "ran"), (11, "ran")}


def test_profile(store):
    total = store.events.where("recording = 'one'").agg(F.sum("elapsed_us")).first()[0]
    st = Q.stacks(store).where("recording = 'one'")
    assert st.agg(F.sum("self_us")).first()[0] == total
    lines = [r.value for r in report.folded(st).collect()]
    assert "root;f;set 1000000" in lines and lines == sorted(lines)
    assert Q.hotspots(store, "scope").where("recording = 'one' and scope = 'f'").first().calls == 2


def test_reports(spark, store):
    found = rules.run(store, only=["dead-options", "clobbers"])
    assert {(r.recording, r.rule, r.line) for r in found.collect()} == {(n, *x) for n in ("one", "two") for x in (("dead-options", 5), ("clobbers", 1))}
    both = report.in_all(found)
    assert {(r.recording, r.line) for r in both.collect()} == {("one", 5), ("one", 1)}
    assert "in all 2 recordings" in report.as_text(both) and report.as_text(both).endswith("2 findings")
    assert report.not_in_baseline(spark, found, report.baseline(found)).count() == 0
    with pytest.raises(ValueError, match="version"):
        report.not_in_baseline(spark, found, '{"baseline_version": 9, "findings": []}')
    assert report.gate(both) == 1 and report.gate(both, "error") == 0
    s = json.loads(report.sarif(both))
    assert s["version"] == "2.1.0" and len(s["runs"][0]["results"]) == 2 and len({r["partialFingerprints"]["place/v1"] for r in s["runs"][0]["results"]}) == 2


def test_graph_text(spark):
    e = spark.createDataFrame([("a", 'b"', "PUBLIC")], "src string, dst string, visibility string")
    assert '"a" -> "b\\"" [label="PUBLIC"];' in report.dot(e) and "n0 -->|PUBLIC| n1" in report.mermaid(e)


def test_sql(spark, folder):
    t = recording.load(spark, str(folder / "db"))
    assert Q.sql(spark, t, "select json_extract(args_json, '$[0]') as x from events where cmd_lower = 'option' and recording = 'one' order by event_id").collect()[1].x == "DEAD"
    with pytest.raises(ValueError, match="only queries"):
        Q.sql(spark, t, "drop table x")
    assert Q.sql_rule(spark, t, "mine", "select file, line, cmd as message from events where cmd_lower = 'unset'").count() == 2
    with pytest.raises(ValueError, match="no column"):
        Q.sql_rule(spark, t, "mine", "select file from events")


def test_sql_rules_over_many_recordings_give_all_rows(spark, tmp_path):
    spark.range(3 * (Q.MOST_ROWS + 1)).select((F.col("id") % (Q.MOST_ROWS + 1)).alias("user_id"), F.lit("error").alias("event_type"), F.current_timestamp().alias("ts")).write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.queries()["sql_rule_findings"](spark, str(tmp_path))
    assert (got.count(), got.select("line").distinct().count()) == (Q.MOST_ROWS + 1, Q.MOST_ROWS + 1)
    with pytest.raises(ValueError, match="more than 1 findings"):
        Q.sql_rule(spark, {"n": spark.range(2)}, "mine", "select 'f' as file, id as line, 'm' as message from n", most=1)


def test_dependencies(spark, tmp_path):
    sha = "b" * 40
    steps = [(1, "find_package", ["Stub", "1.2", "REQUIRED"], 1), (2, "set", ["Stub_FOUND", "TRUE"], 1), (3, "FetchContent_Declare", ["x", "GIT_REPOSITORY", "https://github.com/Own/Lib.git", "GIT_TAG", sha], 1)]
    (tmp_path / "t").write_text(trace_lines(steps))
    src = spark.createDataFrame([(tmp_path.name, SRC, "\n")], "recording string, path string, content string")
    rows = {r.name: r for r in Q.dependencies(rules.Store(recording.ingest(spark, str(tmp_path / "t"), src, "/src"))).collect()}
    assert rows["Stub"].found and rows["Stub"].version == "1.2" and rows["Stub"].required
    assert rows["x"].purl == f"pkg:github/own/lib@{sha}" and rows["x"].problem is None


def test_replies(spark, store, tmp_path):
    put = lambda n, d: (tmp_path / n).write_text(json.dumps(d))
    put("index-1.json", {"objects": []})
    put("index-2.json", {"objects": [{"kind": "codemodel", "jsonFile": "m.json"}]})
    put("m.json", {"configurations": [{"name": "Debug", "targets": [{"jsonFile": "a.json"}]}, {"name": "Other", "targets": []}]})
    put("a.json", {"name": "app", "type": "EXECUTABLE", "backtrace": 1, "backtraceGraph": {"files": ["CMakeLists.txt"], "nodes": [{"file": 0}, {"file": 0, "line": 19, "parent": 0}, {"parent": 1}]},
                   "compileGroups": [{"includes": [{"path": "/i", "backtrace": 2}, {"path": "/i", "backtrace": 2}], "defines": [{"define": "X=1"}]}], "link": {"commandFragments": [{"role": "libraries", "fragment": "libcore.a"}, {"role": "flags", "fragment": "-O"}]},
                   "sources": [{"path": "main.c", "compileGroupIndex": 0}, {"path": "a.h"}]})
    t = replies.read(spark, str(tmp_path), "one", "/src", store.events)
    assert {(r.kind, r.value, r.origin_event) for r in t["usage_reqs"].collect()} == {("include", "/i", 16), ("define", "X=1", None), ("link", "libcore.a", None)}
    assert [r.source_path for r in t["tus"].collect()] == ["/src/main.c"]
    m = {r.name: r for r in replies.merge(store.targets.where("recording = 'one'"), t["targets"]).collect()}
    assert m["app"].in_file_api == 1 and m["core"].in_file_api == 0 and m["app"].defined_event == 16


def test_bill_of_materials_and_trees(spark):
    sha = "b" * 40
    schema = "name string, how string, version string, required boolean, found boolean, source string, problem string, purl string, file string, line long"
    rows = [("Stub", "find_package", "1.2", True, False, None, None, None, "/src/a", 1), ("x", "fetchcontent_declare", sha, True, None, "https://github.com/Own/Lib.git", None, f"pkg:github/own/lib@{sha}", "/src/a", 2), ("y", "fetchcontent_declare", "main", True, None, "r", "can move", None, "/src/a", 3)]
    bom = json.loads(report.bill_of_materials(spark.createDataFrame(rows, schema), "demo"))
    assert (bom["bomFormat"], bom["specVersion"], [c["name"] for c in bom["components"]]) == ("CycloneDX", "1.5", ["Stub", "x", "y"])
    assert [c.get("version") for c in bom["components"]] == [None, sha, None] and [c.get("purl") for c in bom["components"]] == [None, f"pkg:github/own/lib@{sha}", None]
    assert {"name": "tracemill:found", "value": "false"} in bom["components"][0]["properties"]
    hops = spark.createDataFrame([("r", 1, 0, "a", "z", "PUBLIC"), ("r", 2, 0, "a", "b", "PRIVATE"), ("r", 2, 1, "b", "z", "PUBLIC"), ("r", 3, 0, "a", "b", "PRIVATE"), ("r", 3, 1, "b", "c", "PUBLIC")], "recording string, path_id int, hop int, src string, dst string, visibility string")
    assert Q.path_tree(hops) == {"r": {("a", None): {("z", "PUBLIC"): {}, ("b", "PRIVATE"): {("z", "PUBLIC"): {}, ("c", "PUBLIC"): {}}}}}
    edges = spark.createDataFrame([("a", "b", "PUBLIC")], "src string, dst string, visibility string")
    assert json.loads(report.graph_json(edges)) == {"nodes": ["a", "b"], "edges": [{"src": "a", "dst": "b", "visibility": "PUBLIC"}]}
    assert json.loads(report.as_objects(edges).first().value) == {"src": "a", "dst": "b", "visibility": "PUBLIC"}


def test_snapshots_and_second_saves(spark, tmp_path):
    steps = [(1, "set", ["A", "1"], 1), (2, "file", ["APPEND", "snap", "x"], 1)]
    (tmp_path / "t").write_text(trace_lines(steps))
    src = spark.createDataFrame([(tmp_path.name, SRC, "set(A 1)\n")], "recording string, path string, content string")
    dump = lambda v: (tmp_path / "s.tsv").write_text(f"SNAPSHOT\tend\nA\t{v.encode().hex()}\nB\t{'x'.encode().hex()}\n")
    dump("1")
    t = recording.ingest(spark, str(tmp_path / "t"), src, "/src", snapshots=str(tmp_path / "s.tsv"), snapshot_file="snap")
    dump("2")
    with pytest.raises(crosscheck.ReplayError, match="A is '1', dumped as '2'"):
        recording.ingest(spark, str(tmp_path / "t"), src, "/src", snapshots=str(tmp_path / "s.tsv"), snapshot_file="snap")
    (tmp_path / "db" / "files" / "left").mkdir(parents=True)  # by a save that was stopped
    recording.save(t, str(tmp_path / "db"))
    assert recording.load(spark, str(tmp_path / "db"))["files"].count() == 1
    with pytest.raises(FileExistsError):
        recording.save(t, str(tmp_path / "db"))
