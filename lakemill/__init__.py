"""A PySpark-native engine for tabular analytics and search."""
