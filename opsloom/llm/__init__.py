"""Operators of a training-data pipeline: scans, near duplicates, packing, decontamination, archives.

Nothing else in the library imports this subpackage. Every operator is a function from DataFrames to
DataFrames; the thin queries over the given tables are in `queries.py`.
"""
