"""A PySpark-native engine for ground-motion monitoring from repeat imagery."""
