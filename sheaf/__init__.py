"""Spark-native evidence analytics: retrieval, fusion, provenance and lints as DataFrame plans."""
