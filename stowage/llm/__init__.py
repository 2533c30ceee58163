"""Operators for training-data pipelines: filters, scans, joins, mixing, sharding, encoding."""
