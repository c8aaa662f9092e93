"""The rules in reporting order, and the run over all of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.rules import calls, dead, links, values
from tracemill.rules.base import Config, Store

RULES: dict[str, Callable[[Store, Config], DataFrame]] = {
    "dead-options": dead.options,
    "dead-functions": dead.functions,
    "dead-modules": dead.modules,
    "dead-variables": dead.variables,
    "directory-commands": links.directory_commands,
    "option-after-use": values.option_after_use,
    "undefined-reads": values.undefined_reads,
    "genex-in-wrong-context": calls.genex,
    "execute-process-unchecked": calls.unchecked_processes,
    "constant-conditions": values.constant_conditions,
    "env-dependence": values.env_dependence,
    "clobbers": values.clobbers,
    "policy-hygiene": calls.policies,
    "scope-leaks": values.scope_leaks,
    "overshare": links.overshare,
    "configure-warnings": calls.diagnostics,
    "duplicate-links": links.duplicates,
    "cyclic-links": links.cycles,
    "redundant-links": links.redundant,
    "set-cache-force": calls.cache_force,
    "fetchcontent-pinning": calls.pinning,
    "single-use-variables": values.single_use,
    "alias-variables": values.aliases,
    "noop-calls": calls.noops,
    "shadowed-requirements": links.shadowed,
}


def run(store: Store, config: Config | None = None, only: list[str] | None = None) -> DataFrame:
    """Findings of all rules that are enabled, with severities overridden last."""
    config = config or Config()
    on = [r for r in RULES if r not in config.disable and (only is None or r in only)]
    found = reduce(DataFrame.unionByName, [RULES[r](store, config) for r in on])
    for rule, severity in config.severity.items():
        found = found.withColumn("severity", F.when(F.col("rule") == rule, severity).otherwise(F.col("severity")))
    return found
