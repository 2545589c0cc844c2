"""Readers and writers of record formats; each gives DataFrames of records or tuples."""
