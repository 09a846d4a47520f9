"""Spark operators over commerce evidence and training-data corpora."""
