"""Corpora and indexes in files."""
