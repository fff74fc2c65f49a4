"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Every operator is a function of
DataFrames with its own interface; ``llm.queries`` holds the thin registered
queries and ``llm.oracles`` their SQL.
"""
