"""Streams of values into a store."""
