"""Declarations of joins and the physical paths that run them."""
