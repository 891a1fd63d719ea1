"""Spark-native intake, cleaning, duplicate detection and retention of news articles."""

from gazette.schemas import Settings

__all__ = ["Settings"]
