"""Part of inkweave: streaming."""
