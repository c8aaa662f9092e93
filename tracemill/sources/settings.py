"""What stands beside a build: presets, entries given on the command line, a project's settings, its own SQL rules. Small files, read by the driver."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tracemill import model
from tracemill.rules.base import Config

SETTINGS = ".tracemill.toml"
#: A user's presets come first and hide the project's of the same name.
PRESET_FILES = ["CMakeUserPresets.json", "CMakePresets.json"]


def presets(source_dir: str) -> list[dict]:
    """Configure presets of both files, in order. ValueError if a file is no JSON; files may be missing."""
    out: list[dict] = []
    for name in PRESET_FILES:
        path = Path(source_dir, name)
        if path.is_file():
            out += json.loads(path.read_text(encoding="utf-8")).get("configurePresets", [])
    return out


def preset_names(source_dir: str) -> list[str]:
    """Those that can be configured, each once. ValueError if there are no presets at all."""
    found = presets(source_dir)
    if not found:
        raise ValueError(f"{source_dir} has no configure presets")
    return list(dict.fromkeys(p["name"] for p in found if "name" in p and p.get("hidden") is not True))


def _lineage(found: list[dict], name: str) -> Iterator[dict]:
    """A preset and what it inherits from, of several the last first, none twice."""
    by_name = {p.get("name"): p for p in reversed(found)}
    ahead, seen = [name], set()
    while ahead:
        at = ahead.pop()
        if at in seen or at not in by_name:
            continue
        seen.add(at)
        yield by_name[at]
        parents = by_name[at].get("inherits", [])
        ahead += [parents] if isinstance(parents, str) else parents


def binary_dir(source_dir: str, preset: str, environment: dict[str, str] | None = None) -> str:
    """The build folder of a preset or of the first that it inherits from, with its macros replaced. ValueError if there is none."""
    found = presets(source_dir)
    if not any(p.get("name") == preset for p in found):
        raise ValueError(f"no preset {preset}")
    folder = next((p["binaryDir"] for p in _lineage(found, preset) if isinstance(p.get("binaryDir"), str)), None)
    if folder is None:
        raise ValueError(f"preset {preset} has no binaryDir")
    source = os.path.abspath(source_dir)
    values = {"${sourceDir}": source, "${presetName}": preset, "${sourceDirName}": os.path.basename(source), "${dollar}": "$"}
    for macro, value in values.items():
        folder = folder.replace(macro, value)
    env = os.environ if environment is None else environment
    return os.path.join(source, re.sub(r"\$env\{([^}]*)\}", lambda m: env.get(m[1], ""), folder))


def given_entries(arguments: list[str], source_dir: str | None = None, preset: str | None = None) -> dict[str, str]:
    """Cache entries that exist before the first event: -D arguments, then the preset's and what it inherits; the first value of a name counts."""
    out: dict[str, str] = {}
    words = iter(arguments)
    for word in words:
        if word.startswith("-D"):
            name, equals, value = (word[2:] or next(words, "")).partition("=")
            if equals and (name := name.split(":")[0]):
                out.setdefault(name, value)
    for p in _lineage(presets(source_dir), preset) if source_dir and preset else ():
        for name, value in p.get("cacheVariables", {}).items():
            value = value.get("value", "") if isinstance(value, dict) else value
            out.setdefault(name, ("ON" if value else "OFF") if isinstance(value, bool) else str(value))
    out.pop("", None)
    return out


def seeds(spark: SparkSession, recording: str, entries: dict[str, str]) -> DataFrame:
    """The entries as recording.ingest takes them."""
    return spark.createDataFrame([(recording, n, v) for n, v in entries.items()], "recording string, name string, value string")


@dataclass
class Settings:
    root: str
    preset: str | None = None
    capture_scopes: bool = False
    enable: list[str] = field(default_factory=list)
    fail_on: str = "warning"
    sql_dir: str = ".tracemill/rules"
    modernize: list[str] = field(default_factory=list)
    config: Config = field(default_factory=Config)

    def enabled(self, rule: str) -> bool:
        return rule not in self.config.disable and (not self.enable or rule in self.enable)

    def sql_rules(self) -> list[tuple[str, str, str]]:
        return sql_rules(os.path.join(self.root, self.sql_dir))


def _only(table: dict, where: str, known: set[str]) -> None:
    if unknown := sorted(set(table) - known):
        raise ValueError(f"{where}: unknown {', '.join(unknown)}")


def settings(folder: str) -> Settings:
    """The settings of the nearest folder, this one or one above it, that has any; else the defaults. ValueError for unknown keys and severities."""
    start = Path(folder).absolute()
    path = next((d / SETTINGS for d in [start, *start.parents] if (d / SETTINGS).is_file()), None)
    if path is None:
        return Settings(str(start))
    data = tomllib.loads(path.read_text(encoding="utf-8"))
    _only(data, str(path), {"record", "lint", "rules", "modernize", "custom-commands"})
    record, lint, rules, modernize = (dict(data.get(k, {})) for k in ("record", "lint", "rules", "modernize"))
    _only(record, "record", {"preset", "capture-scopes"})
    _only(rules, "rules", {"sql-dir"})
    _only(modernize, "modernize", {"passes"})
    enable, disable, fail_on, severity = lint.pop("enable", []), lint.pop("disable", []), lint.pop("fail-on", "warning"), lint.pop("severity", {})
    for level in [fail_on, *severity.values()]:
        if level not in model.SEVERITIES:
            raise ValueError(f"{path}: no severity {level}")
    ignore = {rule: table["ignore-patterns"] for rule, table in lint.items() if table.get("ignore-patterns")}
    return Settings(
        str(path.parent), record.get("preset"), record.get("capture-scopes", False), enable, fail_on, rules.get("sql-dir", Settings.sql_dir), modernize.get("passes", []),
        Config(ignore=ignore, disable=set(disable), severity=severity),
    )


def sql_rules(folder: str) -> list[tuple[str, str, str]]:
    """rule, description and statement of each *.sql file of a folder, by name: the file's stem, its first comment line, its text. A folder that isn't there has none."""
    out = []
    for path in sorted(Path(folder).glob("*.sql")):
        text = path.read_text(encoding="utf-8")
        comment = re.search(r"^[ \t]*--(.*)$", text, re.M)
        out.append((path.stem, comment[1].strip() if comment else "a rule of the project's own", text))
    return out
