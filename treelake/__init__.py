"""Spark jobs over the metadata of hierarchical scientific-data files."""
