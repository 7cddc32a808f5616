"""Lifecycle analytics on Spark: tables in, explainable review evidence out."""
