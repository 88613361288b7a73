"""Spark-native analytics: review statistics, itemsets, similarity, recommendation, graphs, clustering, sketches, streams."""
