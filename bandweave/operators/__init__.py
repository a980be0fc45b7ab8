"""Operators on sides, windows and results."""
