"""Comparison and consensus clustering of similarity sources on Spark."""
