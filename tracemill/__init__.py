"""Trace analytics on Spark: declarative DataFrame operators over recorded runs."""

__version__ = "0.1.0"
