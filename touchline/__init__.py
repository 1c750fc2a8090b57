"""Spark-native analytics over fixtures, standings and event sequences."""
