"""Streaming generation, an extension."""
