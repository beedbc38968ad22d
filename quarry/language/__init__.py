"""Constraints and notations found in natural language, without a model."""
