"""Whole clustering runs."""
