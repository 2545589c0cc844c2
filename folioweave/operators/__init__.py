"""Operators over the graph tables: look-ups, imports, deletes, statistics, joins."""
