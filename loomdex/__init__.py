"""Hybrid text retrieval and data preparation as declarative Spark plans."""
