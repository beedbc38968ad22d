"""Scoring, ordering, faceting and grouping, each a DataFrame of a DataFrame."""
