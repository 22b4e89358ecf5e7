"""Operators over the graph's tables; each takes and returns DataFrames and runs lazily
unless its docstring names an iteration."""
