"""Readers and writers of source trees."""
