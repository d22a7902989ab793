"""Spark-native analytics over scanned-document containers and text corpora."""
