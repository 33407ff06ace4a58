"""Spark-first analytics over market news and daily price bars."""
