"""Spark-native evaluation analytics: ranking, set metrics, similarity, sampling and text operators on DataFrames."""
