"""A PySpark-native engine for text and vector embeddings."""
