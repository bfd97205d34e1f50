"""Catalogue matching and faceted analytics on Spark."""
