"""Operators of a training-data pipeline over annotated entities; nothing else in the library imports this package."""
