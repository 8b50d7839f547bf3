"""Spark-native entity resolution: cleaning, blocking, top-k retrieval, fusion, evaluation and tuning."""
