"""Palimpsest: a Spark-native engine for versioned, bitemporal knowledge records."""

__version__ = "0.1.0"
