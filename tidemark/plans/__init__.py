"""Compositions of operators: the memory facade."""
