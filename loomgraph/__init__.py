"""Graph ETL and corpus operators for Spark: documents in, triples, findings and versions out."""
