"""Spark pipelines over radio reception reports."""
