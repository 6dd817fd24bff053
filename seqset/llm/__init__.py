"""Operators for training data: one module each, with the query that applies it."""
