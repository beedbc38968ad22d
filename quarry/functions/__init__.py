"""Scalar expressions: text, dates, places, vectors, JSON."""
