"""Operators on memory tables, as lazy DataFrame plans."""
