"""SPARQL over triples on Spark."""
