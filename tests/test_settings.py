"""Presets, given entries, settings and rule folders."""

import json

import pytest

from tracemill.sources import settings


def test_presets_and_entries(tmp_path):
    with pytest.raises(ValueError, match="no configure presets"):
        settings.preset_names(str(tmp_path))
    base = {"name": "base", "hidden": True, "binaryDir": "${sourceDir}/out/${presetName}-$env{KIND}", "cacheVariables": {"A": "1", "B": True, "C": {"type": "PATH", "value": "/c"}}}
    (tmp_path / "CMakePresets.json").write_text(json.dumps({"configurePresets": [base, {"name": "dev", "inherits": ["base"], "cacheVariables": {"A": "2"}}, {"name": "lone"}]}))
    (tmp_path / "CMakeUserPresets.json").write_text(json.dumps({"configurePresets": [{"name": "lone", "binaryDir": "b"}]}))
    root = str(tmp_path)
    assert settings.preset_names(root) == ["lone", "dev"]
    assert settings.binary_dir(root, "dev", {"KIND": "x"}) == f"{root}/out/dev-x" and settings.binary_dir(root, "lone") == f"{root}/b"
    assert settings.given_entries(["-DA=9", "-D", "X:BOOL=ON", "-DNOVALUE"], root, "dev") == {"A": "9", "X": "ON", "B": "ON", "C": "/c"}
    with pytest.raises(ValueError, match="no preset"):
        settings.binary_dir(root, "other")


def test_settings_and_rule_folder(tmp_path):
    inner = tmp_path / "a" / "b"
    inner.mkdir(parents=True)
    assert settings.settings(str(inner)).fail_on == "warning"
    (tmp_path / settings.SETTINGS).write_text('[lint]\ndisable = ["clobbers"]\nfail-on = "error"\n[lint.severity]\ndead-options = "note"\n[lint.dead-variables]\nignore-patterns = ["X.*"]\n[rules]\nsql-dir = "mine"\n')
    got = settings.settings(str(inner))
    assert got.root == str(tmp_path) and got.fail_on == "error" and not got.enabled("clobbers") and got.enabled("dead-options")
    assert got.config.severity == {"dead-options": "note"} and got.config.ignore == {"dead-variables": ["X.*"]}
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "b.sql").write_text("SELECT 1")
    (tmp_path / "mine" / "a.sql").write_text("-- too many\nSELECT 2")
    assert [r[:2] for r in got.sql_rules()] == [("a", "too many"), ("b", "a rule of the project's own")]
    (tmp_path / settings.SETTINGS).write_text("[lint.severity]\nx = 'fatal'\n")
    with pytest.raises(ValueError, match="no severity"):
        settings.settings(str(inner))
