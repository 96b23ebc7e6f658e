"""Relational jobs over the corpus tables."""
