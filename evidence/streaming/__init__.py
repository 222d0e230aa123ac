"""Streaming forms of operators whose input keeps arriving."""
