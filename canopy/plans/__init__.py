"""Schemas, the corpus handle and edit plans."""
