"""Registered queries on the test tables, each beside its SQL twin."""
