"""Queries and transformations over a corpus of source trees."""
