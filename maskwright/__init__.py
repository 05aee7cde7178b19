"""Sensitive-text analytics on Spark."""
