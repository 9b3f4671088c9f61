"""Quillon: a Spark-native engine for mining, encoding and protecting symbol sequences."""
