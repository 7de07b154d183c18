"""Relational, graph, vector and ranking operators as DataFrame transformations."""
