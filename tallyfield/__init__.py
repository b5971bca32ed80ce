"""Spark operators for event-log analytics, peer scoring and training-data preparation."""
