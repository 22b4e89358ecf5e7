"""A PySpark-native code-intelligence graph engine."""
