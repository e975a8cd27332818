"""Spark-native engine for labelled, gridded and point data."""
