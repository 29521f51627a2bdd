"""Whole analyses composed from operators, the named queries, and their SQL."""
