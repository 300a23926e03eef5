"""mensura: a PySpark-native engine for image-derived measurement data."""

__version__ = "0.1.0"
