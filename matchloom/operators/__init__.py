"""Catalogue and item normalization, candidates, evidence and decisions."""
