"""Operators by domain: qc, catalog, joins, tables, events, signal, encoding."""
