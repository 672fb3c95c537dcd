"""loomline: a PySpark-native engine for text-and-timeline corpora."""
