"""Textloom: text retrieval, evidence algebra and map-reduce over corpora, as Spark DataFrame transformations."""
