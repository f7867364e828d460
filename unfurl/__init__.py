"""Spark-native analytics over phase volumes and training-data corpora."""
