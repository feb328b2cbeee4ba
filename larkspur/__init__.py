"""PySpark-native analytics engine for fixed-schema tables."""
