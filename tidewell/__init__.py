"""Tidewell: a Spark-native retrieval, memory-analytics and corpus engine."""
