"""Spark-native analytics over image libraries: catalog, similarity search, clustering and evaluation."""
