"""Spark-native prospect analytics engine."""
