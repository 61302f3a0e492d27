"""Spark-native catalog search and analytics."""
