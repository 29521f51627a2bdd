"""Operators over a DataFrame of documents.

Each takes the frame, the names of its id and text columns, and returns a new frame at one of four grains: document,
sentence, token or type.  A null text counts as an empty one.
"""
