"""Streams into the tables."""
