"""Replay of scopes, variables and the build graph from a trace."""
