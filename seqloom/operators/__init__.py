"""Relational operators over sequence, structure and score tables."""
