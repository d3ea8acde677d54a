"""Whole conversions: documents in, graph, versions and findings out."""
