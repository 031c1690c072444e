"""Part of inkweave: sources."""
