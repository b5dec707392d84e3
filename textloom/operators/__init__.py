"""Operators over corpora: lines, chunks, searches, rankings, evidence."""
