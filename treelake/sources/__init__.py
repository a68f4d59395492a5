"""Readers and writers: files, CSV, N-Triples, documents, registries."""
