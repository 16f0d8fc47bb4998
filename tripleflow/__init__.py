"""Spark-native RDF graph placement and query engine."""
