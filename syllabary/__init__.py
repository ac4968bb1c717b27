"""Spark-native processing of university course catalogues."""
