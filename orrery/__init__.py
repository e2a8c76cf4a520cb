"""Spark jobs over API catalogs, test runs, traffic logs and text corpora."""
