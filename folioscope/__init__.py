"""Spark-native document search and evidence analytics."""
