"""Brindle: a PySpark-native SQL, versioned-store and data-processing engine."""

__version__ = "0.1.0"
