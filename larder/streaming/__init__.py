"""Feeds that arrive as files."""
