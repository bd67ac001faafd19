"""Relational data as a typed, temporal row graph, on PySpark."""
