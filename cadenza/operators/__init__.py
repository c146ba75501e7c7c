"""Relational operators over curves."""
