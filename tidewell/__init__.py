"""tidewell: a PySpark-native engine for market-data capture analytics."""

__version__ = "0.1.0"
