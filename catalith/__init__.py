"""Catalith: a PySpark-native catalogue enrichment and evaluation engine."""
