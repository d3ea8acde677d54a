"""Readers: documents into node tables, node tables and relational tables into triples, N-Triples in and out."""
