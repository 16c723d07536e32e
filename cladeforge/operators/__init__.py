"""Operators of sequence clustering, each a DataFrame in and a DataFrame out."""
