"""PySpark-native code-graph analytics engine."""

__version__ = "0.1.0"
