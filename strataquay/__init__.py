"""Spark-native data-quality, change-tracking and data-preparation engine."""
