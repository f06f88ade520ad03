"""Spark-native decoding and analysis of baseline JPEG collections."""
