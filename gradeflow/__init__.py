"""Spark-native analytics engine for evaluating text recognition at scale."""
