"""Spark-first analytics over large collections of text content."""
