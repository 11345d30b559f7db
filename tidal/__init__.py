"""Spark-native analytics for irregularly sampled daily series, and operators for training data (llm)."""
