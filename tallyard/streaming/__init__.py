"""Streaming of tallyard."""
