"""A Spark-native engine for evidence retrieval and analytics."""
