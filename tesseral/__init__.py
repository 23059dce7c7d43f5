"""Typed values over regions of four-dimensional space-time, on Spark."""

__version__ = "0.0.2"
