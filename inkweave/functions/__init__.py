"""Part of inkweave: functions."""
