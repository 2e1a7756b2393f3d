"""Spark-native media-library analytics: DataFrame in, DataFrame out."""
