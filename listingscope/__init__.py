"""Listing-risk analytics as PySpark DataFrame transformations."""
