"""twofold: two-sided (bipartite) relational analytics and training-data operators on Spark."""
