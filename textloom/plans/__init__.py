"""Registered queries, and answers composed of operators."""
