"""Boxwood: a PySpark-native engine for structured text, change corpora and governed SQL."""
