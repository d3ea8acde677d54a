"""Column functions over RDF terms and strings."""
