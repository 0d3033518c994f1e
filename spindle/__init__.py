"""Spindle: a PySpark-native analytics engine for research-style tables, text and documents."""

__version__ = "0.1.0"
