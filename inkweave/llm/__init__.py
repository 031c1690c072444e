"""Operators for training-data pipelines; nothing else in inkweave imports this subpackage."""
