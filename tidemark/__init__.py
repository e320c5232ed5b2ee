"""Layered agent memory as Spark DataFrames: recall, decay, graph, consolidation and entity resolution."""
