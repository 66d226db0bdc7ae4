"""Spark-native analytics of text pairs and sparse feature activations."""
