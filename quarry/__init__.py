"""Ranked search and analytics over document collections, on Spark."""
