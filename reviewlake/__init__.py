"""Spark-first analytics for review-driven recommendation data."""
