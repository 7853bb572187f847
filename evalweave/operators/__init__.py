"""Operators on DataFrames: metrics, resampling, joins, selection, audits, policies."""
