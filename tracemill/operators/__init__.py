"""Relational operators over recorded runs."""
