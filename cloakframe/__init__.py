"""Spark-native detection and rewriting of sensitive spans."""
