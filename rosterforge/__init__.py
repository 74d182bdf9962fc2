"""Eligibility and identity analytics as Spark DataFrame operations."""
