"""Retrieval-data engine built on the PySpark DataFrame API."""
