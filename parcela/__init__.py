"""Listing-price analytics as Spark DataFrame operations."""
