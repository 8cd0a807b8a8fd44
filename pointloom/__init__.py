"""Spark-native filtered vector search, versioned point collections and their maintenance."""
