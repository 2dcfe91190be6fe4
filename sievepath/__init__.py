"""Spark-native analytics over saved documents: ranking, retrieval and data preparation."""
