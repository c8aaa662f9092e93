"""The rules on a hand-written recording with one case for most of them. The trace is synthetic."""

import json

import pytest
from pyspark.sql import functions as F

from tracemill import recorded, rules, session, syntax
from tracemill.replay import sequential
from tracemill.sources import trace

S, COMMIT = "/src/CMakeLists.txt", "a" * 40
# (text, command, expanded arguments or None where it never runs, depth)
LINES = [
    ('option(DEAD "d" OFF)', "option", ["DEAD", "d", "OFF"], 1),
    ('option(LIVE "d" ON)', "option", ["LIVE", "d", "ON"], 1),
    ("if(LIVE)", "if", ["LIVE"], 1),
    ("endif()", None, None, 1),
    ("function(unused)", "function", ["unused"], 1),
    ("endfunction()", None, None, 1),
    ("set(never 1)", "set", ["never", "1"], 1),
    ('message("${LATE}")', "message", [""], 1),
    ('option(LATE "d" ON)', "option", ["LATE", "d", "ON"], 1),
    ('message("${nevr}")', "message", [""], 1),
    ('if("$<CONFIG>" STREQUAL x)', "if", ["$<CONFIG>", "STREQUAL", "x"], 1),
    ("endif()", None, None, 1),
    ("execute_process(COMMAND git RESULT_VARIABLE rc)", "execute_process", ["COMMAND", "git", "RESULT_VARIABLE", "rc"], 1),
    ("execute_process(COMMAND ls RESULT_VARIABLE ok)", "execute_process", ["COMMAND", "ls", "RESULT_VARIABLE", "ok"], 1),
    ('message("${ok} $ENV{MY_HOME} $ENV{PATH}")', "message", [" "], 1),
    ("set(twice 1)", "set", ["twice", "1"], 1),
    ("set(twice 2)", "set", ["twice", "2"], 1),
    ('message("${twice}")', "message", ["2"], 1),
    ("cmake_policy(SET CMP0042 OLD)", "cmake_policy", ["SET", "CMP0042", "OLD"], 1),
    ("macro(leaky)", "macro", ["leaky"], 1),
    ("  set(leak 1)", None, None, 1),
    ("endmacro()", None, None, 1),
    ("leaky()", "leaky", [], 1),
    ("@21", "set", ["leak", "1"], 2),
    ('message("${leak}")', "message", ["1"], 1),
    ('set(forced 1 CACHE BOOL "doc" FORCE)', "set", ["forced", "1", "CACHE", "BOOL", "doc", "FORCE"], 1),
    ('message("${forced}")', "message", ["1"], 1),
    ("FetchContent_Declare(loose GIT_REPOSITORY r GIT_TAG main)", "FetchContent_Declare", ["loose", "GIT_REPOSITORY", "r", "GIT_TAG", "main"], 1),
    (f"FetchContent_Declare(fixed GIT_REPOSITORY r GIT_TAG {COMMIT})", "FetchContent_Declare", ["fixed", "GIT_REPOSITORY", "r", "GIT_TAG", COMMIT], 1),
    ("include_directories(/inc/)", "include_directories", ["/inc/"], 1),
    ("add_library(a STATIC a.c)", "add_library", ["a", "STATIC", "a.c"], 1),
    ("add_library(b STATIC b.c)", "add_library", ["b", "STATIC", "b.c"], 1),
    ("add_library(c STATIC c.c)", "add_library", ["c", "STATIC", "c.c"], 1),
    ("add_library(d STATIC d.c)", "add_library", ["d", "STATIC", "d.c"], 1),
    ("target_include_directories(a PRIVATE /inc)", "target_include_directories", ["a", "PRIVATE", "/inc"], 1),
    ("target_link_libraries(a PRIVATE b c)", "target_link_libraries", ["a", "PRIVATE", "b", "c"], 1),
    ("target_link_libraries(b PUBLIC c)", "target_link_libraries", ["b", "PUBLIC", "c"], 1),
    ("target_link_libraries(c PRIVATE d debug x optimized x)", "target_link_libraries", ["c", "PRIVATE", "d", "debug", "x", "optimized", "x"], 1),
    ("target_link_libraries(d PRIVATE c)", "target_link_libraries", ["d", "PRIVATE", "c"], 1),
    ("target_link_libraries(d PUBLIC c)", "target_link_libraries", ["d", "PUBLIC", "c"], 1),
    ("target_link_libraries(b PRIVATE ${none_here})", "target_link_libraries", ["b", "PRIVATE", ""], 1),
    ("set(single 7)", "set", ["single", "7"], 1),
    ('message("${single}")', "message", ["7"], 1),
    ("set(other ${twice})", "set", ["other", "2"], 1),
    ('message("${other}${other}")', "message", ["22"], 1),
    ("link_libraries(m)", "link_libraries", ["m"], 1),
    ("if(LIVE AND twice)", "if", ["LIVE", "AND", "twice"], 1),
    ("endif()", None, None, 1),
    ("@47", "if", ["LIVE", "AND", "twice"], 1),
    ("@47", "if", ["LIVE", "AND", "twice"], 1),
]


@pytest.fixture(scope="module")
def store(spark):
    text, rows, ids = "", [], {}
    for i, (src, cmd, args, depth) in enumerate(LINES, 1):
        line = int(src[1:]) if src.startswith("@") else i
        text += "\n" if src.startswith("@") else src + "\n"
        if cmd:
            rows.append(("r", S, line, cmd, cmd.lower(), args, float(i), 0, depth, i))
    raw = spark.createDataFrame(rows, "recording string, file string, line long, cmd string, cmd_lower string, args array<string>, time_abs double, frame long, global_frame long, o long")
    events = trace.number(raw, "o").drop("o").cache()
    src = spark.createDataFrame([("r", S, text), ("r", "/src/lost.cmake", "set(x 1)\n")], "recording string, path string, content string")
    t = syntax.tables(src, "/src", "/build")
    t = t | sequential.tables(events, sequential.log(events, t["commands"], t["nodes"]).cache())
    t = {k: v.cache() for k, v in t.items()}
    diag = spark.createDataFrame([("r", 1, "warning", "dev", "", 0, "careful")], "recording string, diag_id long, severity string, kind string, file string, line long, message string")
    return rules.Store(t | {"configure_diagnostics": diag})


EXPECTED = {
    "dead-options": [(1, "warning")],
    "dead-functions": [(5, "warning")],
    "dead-modules": [(1, "warning")],
    "dead-variables": [(7, "warning")],
    "directory-commands": [(30, "note"), (46, "note")],
    "option-after-use": [(9, "warning")],
    "undefined-reads": [(10, "note"), (41, "note")],
    "genex-in-wrong-context": [(11, "warning")],
    "execute-process-unchecked": [(13, "note")],
    "constant-conditions": [(47, "note")],
    "env-dependence": [(15, "note")],
    "clobbers": [(16, "warning")],
    "policy-hygiene": [(19, "warning")],
    "scope-leaks": [(21, "note")],
    "overshare": [(0, "note")],
    "configure-warnings": [(0, "warning")],
    "duplicate-links": [(40, "warning")],
    "cyclic-links": [(38, "note")],
    "redundant-links": [(36, "note")],
    "set-cache-force": [(26, "warning")],
    "fetchcontent-pinning": [(28, "note")],
    "single-use-variables": [(42, "note")],
    "alias-variables": [(44, "note")],
    "noop-calls": [(41, "note")],
    "shadowed-requirements": [(35, "note")],
}


@pytest.mark.parametrize("rule", EXPECTED)
def test_rule(store, rule):
    out = rules.run(store, only=[rule]).collect()
    assert sorted((f.line, f.severity) for f in out) == EXPECTED[rule], out


def test_config(store):
    got = rules.run(store, rules.Config(ignore={"": ["DE.*"]}, severity={"clobbers": "error"}, disable={"dead-modules"}), only=["dead-options", "clobbers", "dead-modules"]).collect()
    assert [(f.rule, f.severity) for f in got] == [("clobbers", "error")]


def test_tables_of_recordings_are_not_gathered_in_the_driver(spark):
    t = recorded.store(spark, "/root/testdata/sf0.001", recorded.CASES["overshare"][0])
    other = spark.range(10**10).select(F.col("id").alias("event_id"))
    for df in (t.var_reads, t.files.select(F.col("in_source").cast("long").alias("event_id")), t.flags()):
        plan = other.join(df.select("event_id"), "event_id")._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in plan.split("+- ", 1)[1].split("\n")[0] and "SortMergeJoin" in plan
    assert "Join" not in t.flags()._jdf.queryExecution().analyzed().toString()


def test_parsed_sources_are_written_once(spark, monkeypatch):
    written, cut = [], session.cut
    monkeypatch.setattr(session, "cut", lambda df: written.append(df.columns) or cut(df))
    t = recorded.store(spark, "/root/testdata/sf0.001", recorded.CASES["constant-conditions"][0])
    assert [c for c in written if "content" in c or "args_text" in c] == [["recording", "file", "content", "content_hash", "has_errors", "nodes", "commands"]]
    # recordings have their events numbered from 1 without a gap, with the time to the next
    e = t.events.groupBy("recording").agg(F.count("*").alias("n"), F.min("event_id").alias("a"), F.max("event_id").alias("b"), F.count_if(F.expr("elapsed_us = 0")).alias("last"))
    assert e.count() > 1 and e.where("a <> 1 or b <> n or last <> 1").count() == 0


@pytest.mark.parametrize("name", ["replay_conditions_and_lists", "rule_alias_variables", "rule_constant_conditions"])
def test_targets_are_not_made_for_queries_on_variables(spark, monkeypatch, name):
    written, cut = [], session.cut
    monkeypatch.setattr(session, "cut", lambda df: written.append(df.columns) or cut(df))
    assert recorded.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
    assert not [c for c in written if "alias_of" in c]


def test_a_store_asks_once_for_later_tables():
    asked = []
    t = rules.Store({"a": 1}, later=lambda: asked.append(1) or {"a": 2, "b": 3})
    assert (t.a, asked) == (1, [])
    assert (t.b, t.a, t.c, asked) == (3, 1, None, [1])


def test_directory_words_are_held_against_what_was_asked(spark):
    t = recorded.store(spark, "/root/testdata/sf0.001", recorded.CASES["shadowed-requirements"][0])
    from tracemill.rules import links

    calls = links._directory_calls(t).where("cmd_lower = 'include_directories'").select("recording", "call_id", "event_id", "dir_scope", "retroactive", F.col("args")[0].alias("value"))
    asked = t.usage_reqs.select("recording", "target", F.concat("value", F.lit("/")).alias("value")).distinct()
    assert links._affected(t, calls, asked).count() == calls.count() < links._affected(t, calls).count()


@pytest.mark.parametrize("rule", ["shadowed-requirements", "alias-variables", "constant-conditions"])
def test_no_join_of_a_rule_gathers_its_rows_in_the_driver(spark, rule):
    t = recorded.store(spark, "/root/testdata/sf0.001", recorded.CASES[rule][0])
    for df in (rules.RULES[rule](t, rules.Config()), t.tgt_edges, t.usage_reqs, t.events, t.scopes, t.func_defs):
        df.collect()
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
