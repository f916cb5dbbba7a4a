"""A PySpark-native engine for deduplicated, dispersed backup data."""
