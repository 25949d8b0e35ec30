"""Corvane: a Spark-native analytics engine for wide, nested, event-style tables."""
