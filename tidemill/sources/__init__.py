"""Inputs: the star-schema tables, and messages in canonical form."""
