"""Shipping-document data jobs for Spark: chunk, extract, merge, validate, query, correct, project, score."""
