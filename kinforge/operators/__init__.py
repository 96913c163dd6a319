"""Relational operators of the linkage engine."""
