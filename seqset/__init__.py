"""Membership tables and ordered sequences as PySpark DataFrame operators."""
