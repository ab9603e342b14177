"""Relational, graph, search and verification operators."""
