"""Spark-native record linkage, mail extraction and training-data preparation."""
