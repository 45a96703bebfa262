"""Relational, graph, search and dataflow operators over DataFrames."""
