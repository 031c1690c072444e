"""Relational, text, search, graph and verdict operators."""
