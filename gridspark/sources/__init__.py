"""Readers and writers: declared schemas, tolerant parsing, results as folders."""
