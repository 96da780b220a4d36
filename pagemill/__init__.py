"""pagemill: a PySpark-native engine for web and document text."""

__version__ = "0.1.0"
