"""folioflow: a PySpark-native engine for layout-aware document data."""

__version__ = "0.1.0"
