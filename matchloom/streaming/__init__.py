"""Matching of item streams."""
