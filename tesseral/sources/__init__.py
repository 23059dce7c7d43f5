"""Packets, layers and their files."""
