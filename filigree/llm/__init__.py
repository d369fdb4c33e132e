"""Operators on training text.  Optional: nothing outside this package imports it."""
