"""Operators over event tables: rules, sequences, joins, graphs, quality, governance."""
