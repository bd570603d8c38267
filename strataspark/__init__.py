"""Spark-native analytics over versioned snapshots of binary record files."""
