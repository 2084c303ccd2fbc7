"""Retail order events on Spark: layers, quality gate, versioned tables, read models and delivery semantics."""
