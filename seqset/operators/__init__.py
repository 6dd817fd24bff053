"""Operators on membership tables, covers and ordered sequences."""
