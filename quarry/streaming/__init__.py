"""Streams of operations."""
