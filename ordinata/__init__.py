"""Spark-native order, rank and quantile engine over integer sequences."""
