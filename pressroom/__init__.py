"""Batch and streaming Spark jobs over large collections of news articles."""
