"""Causal analytics over property graphs, as Spark jobs."""
