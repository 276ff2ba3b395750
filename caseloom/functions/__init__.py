"""Functions of the case-history library."""
