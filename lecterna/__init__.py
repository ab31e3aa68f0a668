"""Spark-native analytics over media tasks, transcripts, vectors and texts."""
