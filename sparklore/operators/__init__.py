"""Operators over the code graph, text records, vectors and the run ledger: DataFrames in, DataFrames out."""
