"""Spark-native analytics for file synchronisation: listings, change detection, chunk reuse, job stores."""
