"""A PySpark-native engine for causal analysis of text tables."""
