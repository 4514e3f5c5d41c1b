"""Operators over bipartite graphs and their projections."""
