"""Packaged analyses: each takes a recording's tables and returns findings."""

from tracemill.rules.base import Config, Store
from tracemill.rules.registry import RULES, run

__all__ = ["RULES", "Config", "Store", "run"]
