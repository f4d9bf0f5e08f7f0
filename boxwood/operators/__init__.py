"""Relational, tree, graph and learning operators over DataFrames."""
