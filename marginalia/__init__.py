"""A PySpark-native engine for linked document collections."""
