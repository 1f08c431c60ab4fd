"""Operators on element, amendment and annotation tables."""
