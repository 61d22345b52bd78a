"""A Spark-native engine for exact vector search, rank fusion and training-data preparation."""
