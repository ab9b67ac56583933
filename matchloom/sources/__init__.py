"""Readers: the catalogue CSV, item JSON, and built catalogues with their metadata."""
