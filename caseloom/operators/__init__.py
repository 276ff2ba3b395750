"""Operators of the case-history library."""
