"""Spark-native code-graph analytics and corpus preparation."""
