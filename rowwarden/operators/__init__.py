"""Operators over rows that are already typed: validation, splitting, checks, encoding, rendering."""
