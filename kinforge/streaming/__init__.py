"""Linking records that arrive as a stream."""
