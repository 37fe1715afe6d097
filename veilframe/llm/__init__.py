"""Operators that prepare text and sequences for training; nothing outside imports this package."""
