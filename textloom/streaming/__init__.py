"""Searches over text that keeps arriving."""
