"""Catalogue search and column profiling as Spark DataFrame jobs."""
