"""Spark-native analytics over structured legal text."""
