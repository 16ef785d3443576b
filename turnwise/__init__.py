"""turnwise: a PySpark-native analytics engine for task-oriented dialogue data."""
