"""Operators on source text and documents for training data."""
