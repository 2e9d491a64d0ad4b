"""Spark-native provenance analytics."""
