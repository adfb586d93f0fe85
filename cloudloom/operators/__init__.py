"""Relational operators on points, clusters and instances."""
