"""A PySpark-native engine for shuffle-centric dataflow."""
