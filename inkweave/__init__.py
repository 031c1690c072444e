"""Narrative and document analytics as Spark plans."""
