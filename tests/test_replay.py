"""Replay of hand-written traces and sources. The traces are synthetic: no recorder wrote them."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracemill import syntax
from tracemill.replay import effects, sequential
from tracemill.sources import logs, trace

MAIN = '''set(A 1)
set(A 2)
message("${A} ${MISSING}")
option(USE_X "x" ON)
option(DEAD "d" OFF)
function(f arg)
  set(local ${arg})
  set(up "${local}" PARENT_SCOPE)
endfunction()
macro(m arg)
  set(tmp ${arg})
endmacro()
f(hello)
m(there)
message("${up}${tmp}")
if(USE_X)
  add_library(core STATIC a.c)
endif()
add_executable(app main.c)
target_link_libraries(app PRIVATE core PUBLIC core)
unset(A)
message("${A}")
'''
# (line, command, arguments, depth)
STEPS = [
    (1, "set", ["A", "1"], 1), (2, "set", ["A", "2"], 1), (3, "message", ["2 "], 1), (4, "option", ["USE_X", "x", "ON"], 1), (5, "option", ["DEAD", "d", "OFF"], 1),
    (6, "function", ["f", "arg"], 1), (10, "macro", ["m", "arg"], 1), (13, "f", ["hello"], 1), (7, "set", ["local", "hello"], 2), (8, "set", ["up", "hello", "PARENT_SCOPE"], 2),
    (14, "m", ["there"], 1), (11, "set", ["tmp", "there"], 2), (15, "message", ["hellothere"], 1), (16, "if", ["USE_X"], 1), (17, "add_library", ["core", "STATIC", "a.c"], 1),
    (19, "add_executable", ["app", "main.c"], 1), (20, "target_link_libraries", ["app", "PRIVATE", "core", "PUBLIC", "core"], 1), (21, "unset", ["A"], 1), (22, "message", [""], 1),
]
SRC = "/src/CMakeLists.txt"


def trace_lines(steps=STEPS):
    rows = [{"file": SRC, "line": l, "cmd": c, "args": a, "time": i * 0.5, "frame": 1, "global_frame": d} for i, (l, c, a, d) in enumerate(steps)]
    return "\n".join([json.dumps({"version": {"major": 1, "minor": 2}}), *map(json.dumps, rows)]) + "\n"


@pytest.fixture(scope="module")
def recorded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("traces")
    for name in ("one", "two"):
        (folder / name).mkdir()
        (folder / name / "trace.jsonl").write_text(trace_lines())
    events = trace.events(spark, [str(folder / n / "trace.jsonl") for n in ("one", "two")]).cache()
    sources = spark.createDataFrame([(n, SRC, MAIN) for n in ("one", "two")], "recording string, path string, content string")
    t = syntax.tables(sources, "/src", "/build")
    log = sequential.log(events, t["commands"], t["nodes"]).cache()
    return t | sequential.tables(events, log)


def test_events_are_numbered(recorded):
    for n in ("one", "two"):
        ids = [r.event_id for r in recorded["events"].where(F.col("recording") == n).orderBy("event_id").collect()]
        assert ids == list(range(1, len(STEPS) + 1))
    assert recorded["events"].where("node_id is null").count() == 0
    assert {r.elapsed_us for r in recorded["events"].collect()} == {500000, 0}


def test_reads_resolve(recorded):
    w = recorded["var_writes"].where("recording = 'one'")
    r = recorded["var_reads"].where("recording = 'one'").alias("r").join(w.alias("w"), F.col("resolved_write_id") == F.col("write_id"), "left")
    got = {(x.event_id, x.name, x.value, x.read_kind) for x in r.select("r.event_id", "r.name", "w.value", "r.read_kind").collect()}
    assert got == {(3, "A", "2", "expand"), (3, "MISSING", None, "expand"), (9, "arg", "hello", "expand"), (10, "local", "hello", "expand"), (12, "arg", "there", "expand"),
                   (13, "up", "hello", "expand"), (13, "tmp", "there", "expand"), (14, "USE_X", "ON", "condition"), (19, "A", None, "expand")}


def test_scopes_and_graph(recorded):
    one = {k: v.where("recording = 'one'") for k, v in recorded.items()}
    assert {(x.scope_id, x.parent_id, x.kind, x.name, x.transparent) for x in one["scopes"].collect()} == {(1, None, "directory", "", 0), (2, 1, "function", "f", 0), (3, 1, "macro", "m", 1)}
    assert {(x.name, x.scope_id) for x in one["var_writes"].where("name in ('up', 'tmp', 'local')").collect()} == {("up", 1), ("tmp", 1), ("local", 2)}
    assert {(x.src_target, x.dst_target, x.visibility) for x in one["tgt_edges"].collect()} == {("app", "core", "PRIVATE"), ("app", "core", "PUBLIC")}
    assert {(x.name, x.type) for x in one["targets"].collect()} == {("core", "STATIC"), ("app", "EXECUTABLE")}


@pytest.mark.parametrize("text,line", [("", 1), ("{}\n", 1), ('{"version":{"major":2,"minor":0}}\n', 1), (trace_lines()[:-9], 20), (trace_lines() + "nonsense\n", 21), (trace_lines().replace('"global_frame": 1', '"other": 1', 1), 2), ("\x00\x01\x02\n", 1)])
def test_bad_traces_are_refused(spark, tmp_path, text, line):
    p = tmp_path / "t.jsonl"
    p.write_text(text)
    with pytest.raises(trace.TraceError, match=f"line {line}:"):
        trace.check(spark, str(p))


def test_an_unusable_line_fails_the_query(spark, tmp_path):
    p = tmp_path / "t.jsonl"
    p.write_text(trace_lines() + "nonsense\n")
    with pytest.raises(Exception, match="malformed event"):
        trace.events(spark, str(p)).count()


def test_lexer():
    data = 'if(A)\n  set(x "a ${b} \\${c}" [[${d}]] ${e_${f}} $ENV{H}) # note\nendif()\n#[[ x(\n]]\nfoo(é (p q))\n'.encode()
    nodes, rows, errors = syntax.parse(data)
    assert not errors
    by = {r[2]: r for r in rows}
    assert by["set"][8] == ["b", "f"] and by["set"][9] == ["H"] and [k for k, _ in by["set"][4]] == ["bare", "quoted", "bracket", "bare", "bare"]
    assert [v for _, v in by["foo"][4]] == ["é", "(", "p", "q", ")"]
    block = next(n for n in nodes if n[1] == "if_condition")
    assert data[block[2] : block[3]].endswith(b"endif()") and by["set"][10][0][0] == "if_condition"
    assert data[by["foo"][6] : by["foo"][7]].decode() == "foo(é (p q))"


@pytest.mark.parametrize("text", ["", "set(", "set(a", ")", "endif()", "if(a", '"', "[[", "\\", "x y z"])
def test_lexer_tolerates(text):
    syntax.parse(text.encode())


def test_sources_are_parsed_once_in_many_tasks(spark, tmp_path):
    seen = tmp_path / "seen"

    def note(batches):
        for b in batches:
            with seen.open("a") as f:
                f.write("x" * b.num_rows)
            yield b

    files = spark.createDataFrame([("r", f"/src/f{i}", "set(A é)\n  if(A)") for i in range(40)] + [("r", "/other/g", None)], "recording string, path string, content string").coalesce(1)
    t = syntax.tables(files.mapInArrow(note, files.schema), "/src")
    assert [t[n].count() for n in ("files", "nodes", "commands")] == [41, 120, 80]
    assert seen.read_text() == "x" * 41
    assert t["commands"].select(F.spark_partition_id()).distinct().count() > 1
    assert {(r.in_source, r.has_errors, r.content) for r in t["files"].collect()} == {(1, 1, "set(A é)\n  if(A)"), (0, 0, None)}
    assert {(r.name, r.args[-1].value, r.line, r.byte_end, len(r.blocks)) for r in t["commands"].collect()} == {("set", "é", 1, 9, 0), ("if", "A", 2, 17, 1)}


def test_columns_of_lists_are_cut_apart():
    rows = [["a", "b"], None, [], ["é", None], ["c"]]
    lists, words, numbers = pa.array(rows, pa.list_(pa.string())), pa.array(["x", None, "z"]), pa.array([1, None, 3])
    for a, b in ((0, 5), (1, 4), (3, 5), (1, 2), (2, 2)):
        assert sequential._values(lists.slice(a, b - a)) == rows[a:b]
    assert sequential._values(words.slice(1)) == [None, "z"] and sequential._values(numbers.slice(1)) == [None, 3]


def test_the_replay_gets_no_null_lists_and_the_best_command_first(spark):
    text = "set(A 1) set(B 2) set(${C} ${D})\nfoo()\n"
    steps = [(1, "set", ["B", "2"]), (1, "set", ["A", "1"]), (1, "set", ["c", "d"]), (2, "foo", []), (9, "bar", ["x"])]
    rows = [("r", i + 1, SRC, l, 1, c, a) for i, (l, c, a) in enumerate(steps)]
    events = spark.createDataFrame(rows, "recording string, event_id long, file string, line long, global_frame long, cmd_lower string, args array<string>")
    t = syntax.tables(spark.createDataFrame([("r", SRC, text)], "recording string, path string, content string"), "/src")
    given = sequential.ordered(events, t["commands"], t["nodes"])
    assert given.where("kinds is null or values is null or var_refs is null or env_refs is null or seeds is null or args is null").isEmpty() and given.count() == 11
    log = sequential.log(events, t["commands"], t["nodes"]).collect()
    nodes = {r.byte_start: r.node_id for r in t["commands"].collect()}
    assert sorted((r.event_id, r.ref) for r in log if r.what == "at") == [(1, nodes[9]), (2, nodes[0]), (3, nodes[18]), (4, nodes[text.index("foo")]), (5, None)]
    assert [r.name for r in log if r.what == "write"] == ["B", "A", "c"] and [r.name for r in log if r.what == "read"] == ["C", "D"]


def test_plain_commands_are_lexed_as_others():
    plain, other = syntax.commands(b"a(x ${y}\n z;w)b ( )\n\tc(1)"), syntax.commands(b"a(#[[]]x ${y}\n z;w)b (#[[]] )\n\tc(1#[[]])")
    assert [(c.name, c.args) for c in plain[0]] == [(c.name, c.args) for c in other[0]] == [("a", [("bare", "x"), ("bare", "${y}"), ("bare", "z;w")]), ("b", []), ("c", [("bare", "1")])]
    assert [(c.start, c.end) for c in plain[0]] == [(0, 14), (14, 19), (21, 25)] and not plain[1] and not other[1]
    assert syntax.commands(b"a b(x)")[1] and syntax.commands(b"a-b(x)")[1] and syntax.commands(b"a(x")[1]


def test_conditions():
    bare = lambda s: [("bare", v) for v in s.split()]
    assert effects.conditions(bare("NOT A AND DEFINED B OR x STREQUAL ON")) == [("A", False), ("B", True), ("x", False)]
    assert effects.conditions(bare("TARGET foo AND a MATCHES b AND z IN_LIST L")) == [("a", False), ("z", False), ("L", True)]


def test_block_scope(spark):
    text = "block()\n  set(v 1)\n  message(${v})\nendblock()\nmessage(${v})\n"
    steps = [(1, "block", [], 1), (2, "set", ["v", "1"], 1), (3, "message", ["1"], 1), (4, "endblock", [], 1), (5, "message", [""], 1)]
    rows = [("r", i + 1, SRC, l, d, c, a, None, 0.0) for i, (l, c, a, d) in enumerate(steps)]
    events = spark.createDataFrame(rows, "recording string, event_id long, file string, line long, global_frame long, cmd_lower string, args array<string>, cmd string, time_abs double")
    t = syntax.tables(spark.createDataFrame([("r", SRC, text)], "recording string, path string, content string"), "/src")
    reads = sequential.log(events, t["commands"], t["nodes"]).where("what = 'read'").orderBy("event_id").collect()
    assert [(r.event_id, r.ref is None) for r in reads] == [(3, False), (5, True)]


def test_diagnostics(spark, tmp_path):
    p = tmp_path / "err.txt"
    p.write_text("-- ok\nCMake Warning (dev) at a/b.cmake:12 (foo):\n  Policy CMP0042 is not set:\n  more\n\n  three\n  four\nother\nCMake Error in c.txt:\n  bad\n\nCMake Deprecation Warning at d:3 (x):\n  old\nCMake Warning:\n  unused\n")
    got = [tuple(r) for r in logs.diagnostics(spark, str(p)).drop("recording").orderBy("diag_id").collect()]
    assert got == [(1, "note", "policy", "a/b.cmake", 12, "Policy CMP0042 is not set: more three"), (2, "error", "", "c.txt", 0, "bad"), (3, "warning", "deprecation", "d", 3, "old"), (4, "warning", "", "", 0, "unused")]


def test_snapshots_and_headers(spark, tmp_path):
    p = tmp_path / "snap.tsv"
    p.write_text("SNAPSHOT\tend\nA\t" + "é;b".encode().hex() + "\nB\t\nSNAPSHOT\tend\nA\t31zz\n")
    got = {(r.snapshot, r.tag, r.name, r.value) for r in logs.snapshots(spark, str(p)).collect()}
    assert got == {(1, "end", "A", "é;b"), (1, "end", "B", ""), (2, "end", "A", "1")}
    d = tmp_path / "deps.txt"
    d.write_text("CMakeFiles/app.dir/sub/main.c.o: #deps 2, deps mtime 1 (VALID)\n    /src/sub/main.c\n    ../src/inc/a.h\n\nother: #deps 1\n    x\n")
    tus = spark.createDataFrame([(tmp_path.name, "app", "/src/sub/main.c")], "recording string, target string, source_path string")
    assert [r.header_path for r in logs.headers(spark, str(d), tus, "/build").collect()] == ["/src/inc/a.h"]
