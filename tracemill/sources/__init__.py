"""Readers of what a recorder leaves behind."""
