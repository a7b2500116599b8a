"""Matching and recommendation analytics as Spark DataFrame transformations."""
