"""Rewrites planned on a hand-written synthetic trace."""

import hashlib

import pytest

from tests.test_replay import SRC, trace_lines
from tracemill import codemods, recording, rules

TEXT = "include_directories(/inc/ /two)\nadd_definitions(-DX=1)\nlink_libraries(${odd})\nadd_library(a STATIC é.c)\nadd_executable(b b.c)\n"
STEPS = [(1, "include_directories", ["/inc/", "/two"], 1), (2, "add_definitions", ["-DX=1"], 1), (3, "link_libraries", ["$<A:b>"], 1), (4, "add_library", ["a", "STATIC", "é.c"], 1), (5, "add_executable", ["b", "b.c"], 1)]


def test_plan_and_patch(spark, tmp_path):
    (tmp_path / "t").write_text(trace_lines(STEPS))
    r = tmp_path.name
    src = spark.createDataFrame([(r, SRC, TEXT)], "recording string, path string, content string")
    t = recording.ingest(spark, str(tmp_path / "t"), src, "/src")
    rows = [(r, x, "include", v, None, "fileapi", 1) for x in "ab" for v in ("/inc", "/two")] + [(r, "a", "define", "X=1", None, "fileapi", 2)]
    resolved = spark.createDataFrame(rows, "recording string, target string, kind string, value string, visibility string, source string, origin_event long")
    store = rules.Store(t | {"usage_reqs": t["usage_reqs"].unionByName(resolved)})
    plan = codemods.plan(store).cache()
    assert {(p.rule, p.line) for p in plan.where("problem is not null").collect()} == {("modernize-add_definitions", 2), ("modernize-link_libraries", 3)}
    new = codemods.patched(store, plan).first()
    assert new.content == (
        "\nadd_definitions(-DX=1)\nlink_libraries(${odd})\nadd_library(a STATIC é.c)\ntarget_include_directories(a PRIVATE /inc/ /two)\n"
        "add_executable(b b.c)\ntarget_include_directories(b PRIVATE /inc/ /two)\n")
    assert "-include_directories(/inc/ /two)" in new.diff


def test_apply_refuses():
    h = hashlib.sha256(b"abc").hexdigest()
    assert codemods.apply_edits(b"abc", [(1, 2, "X"), (3, 3, "!")], h) == b"aXc!"
    with pytest.raises(ValueError, match="changed"):
        codemods.apply_edits(b"abd", [], h)
    with pytest.raises(ValueError, match="overlap"):
        codemods.apply_edits(b"abc", [(0, 2, ""), (1, 3, "")], h)
